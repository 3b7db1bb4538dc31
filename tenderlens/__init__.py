"""Rule-based review of large collections of paged tender documents, on Spark."""
