"""Every query by name, and the SQL that gives the same rows."""

from __future__ import annotations

from loomwork.plans import graphs, mining, ratings, streams, summaries

MODULES = (summaries, mining, graphs, ratings, streams)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
