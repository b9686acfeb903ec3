"""Registry of the named queries and their independent SQL forms."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def with_ctes(*ctes: str) -> str:
    return "with recursive " + ",\n".join(c.strip() for c in ctes) + "\n"


def rounded(df, digits: int = 6, **special: int):
    """Round every double, so that sums in another order compare equal."""
    from pyspark.sql import functions as F, types as T

    return df.select(*[
        F.round(F.col(f.name), special.get(f.name, digits)).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema
    ])
