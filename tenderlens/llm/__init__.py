"""Operators for building training corpora: language, quality, duplicates, contamination, personal data, tokens, chat."""
