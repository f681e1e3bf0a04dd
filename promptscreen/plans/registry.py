"""All queries but those of the corpus operators, and their SQL."""

from __future__ import annotations

from . import models, oracle, queries, relations

QUERIES = {**queries.QUERIES, **relations.QUERIES, **models.QUERIES}
SQL = {**oracle.SQL, **relations.SQL, **models.SQL}
