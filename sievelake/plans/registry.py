"""Where the query modules put their queries and DuckDB twins."""

from __future__ import annotations

from sievelake.runtime import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(*tables: str, sql: str | None = None):
    """Register a function of the named tables as a query of (spark, sf_dir)."""

    def put(f):
        def run(spark, sf_dir):
            return f(*(table(spark, sf_dir, t) for t in tables))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put
