"""All named queries and their SQL."""

from __future__ import annotations

from ionquarry.plans import chromatography_queries, infusion_queries, library_queries, queries, relation_queries, spectrum_queries

_MODULES = (queries, spectrum_queries, chromatography_queries, library_queries, relation_queries, infusion_queries)  # importing them registers their queries
QUERIES, ORACLES = queries.QUERIES, queries.ORACLES
