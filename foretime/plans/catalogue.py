"""All queries and their SQL: importing the modules registers them."""

from __future__ import annotations

from foretime.plans import feeds, live, pricing, queries, readers, reports, settlements, skaters, sweeps

MODULES = (queries, pricing, reports, feeds, readers, live, settlements, skaters, sweeps)
QUERIES, SQL, flagship = queries.QUERIES, queries.SQL, queries.flagship
