"""All queries of the core and their SQL."""

from __future__ import annotations

from skein.plans import problems, reference

QUERIES = {**reference.QUERIES, **problems.QUERIES}
SQL = {**reference.SQL, **problems.SQL}
