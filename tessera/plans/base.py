"""Registration of queries with the SQL that gives the same rows."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame


def plain(df: DataFrame) -> DataFrame:
    """Short integers as long and dates as text, so that results compare across engines."""
    casts = {"int": "long", "smallint": "long", "tinyint": "long", "date": "string"}
    return df.select(*[df[c].cast(casts[t]).alias(c) if t in casts else df[c] for c, t in df.dtypes])


def registrar(queries: dict, oracles: dict):
    def query(sql: str | None = None):
        def put(f):
            queries[f.__name__] = wraps(f)(lambda spark, sf_dir: plain(f(spark, sf_dir)))
            if sql is not None:
                oracles[f.__name__] = sql
            return f

        return put

    return query
