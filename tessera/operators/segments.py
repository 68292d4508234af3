"""Scans over ordered rows of a key, of which one may hold most rows: in ranges, whose summaries compose.

Rows are sorted over all tasks by key and order, so a range is a part of a task's size and a hot key spans several. What a range does to a scan is
folded to a summary; summaries of the ranges of a key are scanned, one row to a range; then each range is gone through from its entering
state. A range has one key at most that goes on from the range before, so entering states are one row to a range and are broadcast.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.files import shared_folder

RANGE = "_range"


def stored(rows: DataFrame, tag: str) -> DataFrame:
    """rows as a Parquet table in the shared folder."""
    path = f"{shared_folder(rows.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def in_ranges(rows: DataFrame, keys: Sequence[str], order: Sequence[str], ranges: int | None = None) -> DataFrame:
    """rows with the number of their range, which grows with (keys, order). Written, so that the numbers stand."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *keys, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def entering(summaries: DataFrame, keys: Sequence[str], states: Mapping[str, Column]) -> DataFrame:
    """(range, keys, states) where a key goes on from the range before; states are windows over the summaries of a key by range."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(RANGE))
    held = summaries.withColumn("_first", first).select(*keys, RANGE, "_first", *[c.alias(n) for n, c in states.items()])
    return held.where("_first > 1").drop("_first")


def with_entering(rows: DataFrame, states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """rows with the entering state of their range, null where their key begins there."""
    named = states.select(F.col(RANGE).alias("_of"), *[F.col(k).alias(f"_of_{k}") for k in keys], *[c for c in states.columns if c != RANGE and c not in keys])
    same = F.col(RANGE) == F.col("_of")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return rows.join(F.broadcast(named), same, "left").drop("_of", *[f"_of_{k}" for k in keys])


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], sums: Mapping[str, Column] | None = None, maxima: Mapping[str, Column] | None = None, before: bool = False) -> DataFrame:
    """in_ranges() rows with running sums and maxima over the rows of their key up to them; with before, over those before them."""
    parts = [(n, c, F.sum) for n, c in (sums or {}).items()] + [(n, c, F.max) for n, c in (maxima or {}).items()]
    combined = {F.sum: lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), F.max: F.greatest}
    whole = rows.groupBy(*keys, RANGE).agg(*[f(c).alias(f"_all_{n}") for n, c, f in parts])
    earlier = Window.partitionBy(*keys).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    held = with_entering(rows, entering(whole, keys, {f"_from_{n}": f(f"_all_{n}").over(earlier) for n, _, f in parts}), keys)
    inside = Window.partitionBy(*keys, RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    out = held.withColumns({n: combined[f](f(c).over(inside), F.col(f"_from_{n}")) for n, c, f in parts})
    return out.drop(*[f"_from_{n}" for n, _, _ in parts])


def spanning(rows: DataFrame, key: str) -> DataFrame:
    """Rows of keys with several ranges. These keys are fewer than the ranges."""
    several = rows.groupBy(key).agg(F.min(RANGE).alias("_lo"), F.max(RANGE).alias("_hi")).where("_lo < _hi").select(F.col(key).alias("_several"))
    return rows.join(F.broadcast(several), F.col(key) == F.col("_several")).drop("_several")


def replayed(rows: DataFrame, key: str, order: Sequence[str], summary: Callable[[pd.DataFrame], object], compose: Callable[[object, object], object], replay: Callable[[object, pd.DataFrame], tuple[object, list]], start: object, keep: str, out: str) -> DataFrame:
    """Columns keep, and one named out, of in_ranges() rows, by a state that each row of a non-null key changes.

    summary(range) tells what a range does, compose(state, summary) the state it leaves, and replay(state, rows) the state after some rows and
    their outcomes. All three take rows in order. keep and out are given with their types. Ranges are read batch by batch in the replay.
    """
    import pickle

    dealt = lambda of: of.repartition(key, RANGE).sortWithinPartitions(key, RANGE, *order)
    kind = dict(rows.dtypes)[key]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[tuple, pd.DataFrame]]:
        for batch in batches:
            yield from batch.groupby([key, RANGE], sort=False)

    def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []

        def told() -> pd.DataFrame:
            return pd.DataFrame({key: [at[0]], RANGE: [at[1]], "_does": [pickle.dumps(summary(pd.concat(held)))]})

        for name, part in groups(batches):
            if name != at and held:
                yield told()
                held = []
            at = name
            held.append(part)
        if held:
            yield told()

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start
        for batch in batches:
            entered = []
            for k, does in zip(batch[key].tolist(), batch["_does"].tolist(), strict=True):
                at, state = (at, state) if k == at else (k, start)
                entered.append(pickle.dumps(state))
                state = compose(state, pickle.loads(does))
            yield batch[[key, RANGE]].assign(_enters=entered)

    does = dealt(spanning(rows, key)).mapInPandas(summarise, f"{key} {kind}, {RANGE} int, _does binary")
    enters = does.repartition(key).sortWithinPartitions(key, RANGE).mapInPandas(scan, f"{key} {kind}, {RANGE} int, _enters binary")

    names = [c.split()[0] for c in keep.split(", ")]

    def go(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, state = None, start
        for name, part in groups(batches):
            if name != at:
                first = part["_enters"].iloc[0]
                at, state = name, start if first is None else pickle.loads(bytes(first))
            state, outcomes = replay(state, part)
            yield part[[f"_keep_{n}" for n in names]].assign(**{out.split()[0]: outcomes})

    # What is only kept passes through as text, as pandas would round long numbers beside nulls.
    held = dealt(with_entering(rows.where(F.col(key).isNotNull()), enters, [key])).withColumns({f"_keep_{n}": F.col(n).cast("string") for n in names})
    done = held.mapInPandas(go, ", ".join([*[f"_keep_{n} string" for n in names], out]))
    return done.select(*[F.col(f"_keep_{n}").cast(t).alias(n) for n, t in (c.split() for c in keep.split(", "))], out.split()[0])
