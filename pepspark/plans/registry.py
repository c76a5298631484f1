"""The registered queries of the analytics operators and their SQL."""

from __future__ import annotations

from pepspark.plans import domain, functions, relational

QUERIES = {**relational.QUERIES, **functions.QUERIES, **domain.QUERIES}
ORACLE_SQL = {**relational.ORACLE, **functions.ORACLE, **domain.ORACLE}


def flagship(spark, sf_dir):
    """Accepted precursors, peptides and proteins by run and over all runs."""
    return QUERIES["dom35_identification_summary"](spark, sf_dir)
