"""Suffix arrays of many symbol sequences at once, by distributed prefix doubling.

A sequence is a row with symbols at places 0, 1, ...; a symbol that occurs once ends the suffixes before it like the end of
the row does, as a terminator that sorts before all symbols. Each round makes the depth to which suffixes are told apart
up to twice as large: suffixes of one rank are ordered by the rank of the suffix as many places on. A rank is the number
of suffixes before its interval of the array, so ranks are places in the array, and a suffix alone in its interval has its
final one and leaves the rounds. They end when no interval holds two suffixes.

No interval has to fit one task: distinct keys with their counts are sorted by range, and an interval that crosses from
one task to the next is carried over by a number for each task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, release

KEY = ("rank", "k0", "k1", "k2", "k3")
_PLACED = "rank long, k0 int, k1 long, k2 long, k3 long, n long, first struct<id:long,row:long,at:int>, before long, task long"


def _count_before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For keys in order: how many suffixes of the same rank this task has seen before."""
    from pyspark import TaskContext

    task, held, seen = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        rank, n = batch.column("rank").to_numpy(), batch.column("n").to_numpy()
        if not len(rank):
            continue
        heads = np.flatnonzero(np.diff(rank, prepend=rank[0] - 1))
        run = np.searchsorted(heads, np.arange(len(rank)), side="right") - 1
        total = np.cumsum(n) - n
        before = total - total[heads][run]
        if held == rank[0]:
            before[run == 0] += seen
        held, seen = rank[-1], before[-1] + n[-1]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before), pa.array(np.full(len(rank), task, dtype=np.int64))], names=[*batch.schema.names, "before", "task"])


def interval_starts(keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """KEY, n, first and start: where the interval of each distinct key begins; and the table to release after use."""
    placed = cut(keys.repartitionByRange(*KEY).sortWithinPartitions(*KEY).mapInArrow(_count_before, _PLACED), "suffix-keys")
    # A row for each task: the ranks it begins and ends with, and how many suffixes of the last one it has seen.
    tasks = placed.groupBy("task").agg(F.min("rank").alias("low"), F.max(F.struct("rank", (F.col("before") + F.col("n")).alias("seen"))).alias("high")).orderBy("task").collect()
    carries, rank, seen = [], None, 0
    for t in tasks:
        carry = seen if t.low == rank else 0
        carries.append((t.task, t.low, carry))
        rank, seen = t.high.rank, t.high.seen + (carry if t.high.rank == t.low else 0)
    table = F.broadcast(keys.sparkSession.createDataFrame(carries, "task long, low long, carry long"))
    start = F.col("rank") + F.col("before") + F.when(F.col("rank") == F.col("low"), F.col("carry")).otherwise(0)
    return placed.join(table, "task").select(*KEY, "n", "first", start.alias("start")), placed


def _keyed(suffixes: DataFrame, rank: Column, k0: Column, *ks: Column) -> DataFrame:
    return suffixes.select("id", "row", "at", "tag", "shared", "first_1", "first_d", rank.alias("rank"), k0.cast("int").alias("k0"), *[k.cast("long").alias(f"k{i + 1}") for i, k in enumerate(ks)])


def _ranked(keyed: DataFrame, depth: int, marks: tuple[str, ...]) -> DataFrame:
    """The suffixes that have a partner or had one before, with new ranks: id, row, at, tag, shared, first_1, first_d, rank, n.

    depth: to which they were equal before. marks: which of first_1 and first_d become the first place of the new interval.
    """
    keys = keyed.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "row", "at")).alias("first"))
    if depth == 0:
        keys = keys.where("n > 1")
    starts, table = interval_starts(keys)
    joined = keyed.join(starts, [*KEY])
    out = joined.select(
        "id", "row", "at", "tag",
        F.when(F.col("start") == F.col("rank"), F.col("shared")).otherwise(F.lit(depth)).alias("shared"),
        *[(F.col("first") if m in marks else F.col(m)).alias(m) for m in ("first_1", "first_d")],
        F.col("start").alias("rank"), "n",
    )
    out = cut(out, "suffix-ranks")
    release(table)
    return out


def suffix_array(symbols: DataFrame, depth: int) -> DataFrame:
    """A row for each place whose symbol occurs twice or more: id, row, at, tag; rank, its place in the suffix array;
    shared, how many symbols it has in common with its neighbour before it there; first_1 and first_d, the first places
    (id, row, at) of the intervals that have 1 and `depth` symbols in common, first_d null where there is no such interval.

    symbols: id, row, at, tag and a, b, c, which name the symbol; tag is carried along. shared is exact below `depth`; from
    there on it is the depth of the last round that had the two in one interval.
    """
    place = "struct<id:bigint,row:bigint,at:int>"
    none = symbols.select("*", F.lit(0).alias("shared"), F.lit(None).cast(place).alias("first_1"), F.lit(None).cast(place).alias("first_d"))
    first = _keyed(none, F.lit(0).cast("long"), F.lit(1), F.col("a"), F.col("b"), F.col("c"))
    made = [_ranked(first, 0, ("first_1", "first_d") if depth == 1 else ("first_1",))]
    h = 1
    while not (live := made[-1].where("n > 1")).isEmpty():
        step = min(h, depth - h) if h < depth else h
        known = reduce(DataFrame.unionAll, [*[t.where("n = 1") for t in made[:-1]], made[-1]])
        ahead = known.select("row", (F.col("at") - step).alias("at"), F.col("rank").alias("following"))
        pairs = live.join(ahead, ["row", "at"], "left")
        gone = F.col("following").isNull()  # a terminator comes before every symbol, and terminators by place
        own = lambda c: F.when(gone, F.col(c)).otherwise(0)
        keyed = cut(_keyed(pairs, F.col("rank"), F.when(gone, 0).otherwise(1), F.when(gone, F.coalesce("id", F.lit(-(2**63)))).otherwise(F.col("following")), own("row"), own("at")), "suffix-pairs")
        made.append(_ranked(keyed, h, ("first_d",) if h + step == depth else ()))
        release(keyed)
        h += step
    out = cut(reduce(DataFrame.unionAll, [t.where("n = 1") for t in made]).drop("n"), "suffix-array")
    release(*made)
    return out
