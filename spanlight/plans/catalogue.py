"""All registered queries of the library and their SQL."""

from __future__ import annotations

from spanlight.plans import history, matching, misc, reach, readers, stores

PARTS = (reach, history, matching, misc, readers, stores)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
