"""Registered queries, each with its DuckDB equivalent."""

from millrace.plans import admission, extraction, joins, ledgers, publishing, records, reports, search, storefront, structure, verifying
from millrace.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "admission", "extraction", "joins", "ledgers", "publishing", "records", "reports", "search", "storefront", "structure", "verifying"]
