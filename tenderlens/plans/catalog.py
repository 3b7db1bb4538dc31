"""All registered queries."""

from tenderlens.plans import catalog_audit, catalog_evidence, catalog_flow, catalog_judgements, catalog_pages, catalog_retrieval, catalog_verify, catalog_wording  # noqa: F401
from tenderlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
