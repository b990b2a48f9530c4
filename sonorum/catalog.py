"""All registered queries over the provided tables, and their SQL."""

from __future__ import annotations

from .plans import base, recordings, scalars, sequences, tables  # noqa: F401  (they register)


def flagship(spark, sf_dir):
    return base.QUERIES["render_and_verify"](spark, sf_dir)


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
