"""The queries of the library and the SQL they are held against."""

from __future__ import annotations

from lakeprobe.plans import collect_queries, data_queries, drift_queries, export_queries, job_queries, net_queries, security_queries, source_queries, text_queries, web_queries

MODULES = (drift_queries, text_queries, web_queries, data_queries, job_queries, net_queries, security_queries, export_queries, source_queries, collect_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
