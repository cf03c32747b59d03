"""Exact ranks, first rows and running numbers of groups of any size, without an array or a window over a whole group.

* ``quantiles`` finds the values at given ranks by refining histograms: each round counts the values between the two bounds known so far in
  ``BUCKETS`` ranges, summed in every task before the shuffle, and goes on in the range that holds the rank, until its bounds are equal. Ranges are
  those of the sign first, then of the logarithm, then linear, so nine rounds are enough for any doubles.
* ``first_rows`` keeps each key's first n rows in every task as batches pass, then of what the tasks have kept.
* ``numbered`` numbers rows in a total order from the sizes of ranges that are sorted each by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talus.store import stored

BUCKETS, FEW = 1024, 10_000


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[f"_{k}"]) for k in keys], F.lit(True))


def _with(rows: DataFrame, state: DataFrame, keys: list[str]) -> DataFrame:
    """Every row with the states of its keys; few states go to the rows."""
    state = state.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in state.columns if c not in keys])
    few = state.limit(FEW + 1).count() <= FEW
    return rows.join(F.broadcast(state) if few else state, _same(rows, state, keys))


def _bucket(v: Column, lo: Column, hi: Column) -> Column:
    """The range of a value between its bounds, rising with it."""
    place = lambda x, a, b: F.least(F.floor((x - a) / (b - a) * BUCKETS), F.lit(BUCKETS - 1))
    # halves, as the difference of two doubles can leave the doubles
    linear = place(v / 2, lo / 2, hi / 2)
    return (
        F.when((lo < 0) & (hi > 0) | ((lo == 0) | (hi == 0)) & (lo != hi), F.signum(v).cast("bigint"))
        .when((lo > 0) & (hi / 4 > lo), place(F.log(v), F.log(lo), F.log(hi)))
        .when((hi < 0) & (lo / 4 < hi), place(-F.log(-v), -F.log(-lo), -F.log(-hi)))
        .otherwise(linear)
    )


def ranked_values(df: DataFrame, keys: list[str], value: str, ranks: DataFrame) -> DataFrame:
    """(keys, rank, value) of ``ranks(keys, rank)``: the value at a rank from 0 on, in rising order; nulls have no rank, NaN comes last."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where("_v is not null")
    finite = rows.where(~F.isnan("_v") & (F.abs("_v") < float("inf")))
    odd = lambda x: F.count_if(F.col("_v") == x)
    ends = rows.groupBy(*keys).agg(odd(float("-inf")).alias("low"), odd(float("inf")).alias("high"), F.count_if(F.isnan("_v")).alias("nan"), F.count("*").alias("n"),
                                   F.min(F.when(F.abs("_v") < float("inf"), F.col("_v"))).alias("lo"), F.max(F.when(F.abs("_v") < float("inf"), F.col("_v"))).alias("hi"))
    state = _with(ranks.select(*keys, "rank"), ends, keys).where("rank >= 0 and rank < n")
    beyond = F.when(F.col("rank") < F.col("low"), float("-inf")).when(F.col("rank") >= F.col("n") - F.col("nan"), float("nan")).when(F.col("rank") >= F.col("n") - F.col("nan") - F.col("high"), float("inf"))
    state = stored(state.select(*keys, "rank", (F.col("rank") - F.col("low")).alias("rest"), F.coalesce(beyond, "lo").alias("lo"), F.coalesce(beyond, "hi").alias("hi")), "ranks")
    found = []
    done = F.isnan("lo") | (F.col("lo") == F.col("hi"))
    while True:
        found.append(state.where(done).select(*keys, "rank", F.col("lo").alias("value")))
        state = state.where(~done)
        if state.isEmpty():
            break
        inside = _with(finite, state, keys).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        per = [*keys, "rank", "rest"]
        counts = inside.groupBy(*per, _bucket(F.col("_v"), F.col("lo"), F.col("hi")).alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        upto = F.sum("c").over(Window.partitionBy(*keys, "rank").orderBy("b"))
        hit = counts.withColumn("upto", upto).where((F.col("rest") < F.col("upto")) & (F.col("rest") >= F.col("upto") - F.col("c")))
        state = stored(hit.select(*keys, "rank", (F.col("rest") - (F.col("upto") - F.col("c"))).alias("rest"), "lo", "hi"), "ranks")
    return reduce(DataFrame.union, found)


def quantiles(df: DataFrame, keys: list[str], value: str, linear: dict[str, float] | None = None, nearest: dict[str, float] | None = None) -> DataFrame:
    """One row a group with a column for each share: ``linear`` ones between two ranks, ``nearest`` ones at min(n - 1, int(share n)). Null where a group has no values."""
    groups = stored(df.groupBy(*keys).agg(F.count(F.col(value)).alias("_n")), "groups")
    place = {c: s * F.greatest(F.col("_n") - 1, F.lit(0)) for c, s in (linear or {}).items()}
    want = {(c, "a"): F.floor(p) for c, p in place.items()} | {(c, "b"): F.ceil(p) for c, p in place.items()}
    want |= {(c, "a"): F.least(F.col("_n") - 1, F.floor(F.lit(s) * F.col("_n"))) for c, s in (nearest or {}).items()}
    ranks = groups.select(*keys, F.explode(F.array(*[p.cast("bigint") for p in want.values()])).alias("rank")).distinct()
    got = ranked_values(df, keys, value, ranks).groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("_at"))  # a few ranks a group
    both = _left(groups, got, keys)
    at = lambda p: F.try_element_at("_at", p.cast("bigint"))
    out = {c: at(want[c, "a"]) for c in nearest or {}}
    for c, p in place.items():
        low, high = F.floor(p), F.ceil(p)
        out[c] = F.when(low == high, at(low)).otherwise((high - p) * at(low) + (p - low) * at(high))
    return both.select(*keys, *[x.alias(c) for c, x in out.items()])


def _left(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    right = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    return left.join(right, _same(left, right, keys), "left")


def first_rows(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, all of them if fewer; what is shuffled are ``n`` rows a key and task at most."""
    names = df.columns
    by = [*keys, *order]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None
        for batch in batches:
            both = pa.Table.from_batches([batch])
            both = pa.concat_tables([kept, both]) if kept is not None else both
            both = both.sort_by([(c, "ascending") for c in by])
            ids = both.select(keys).to_pandas() if keys else pd.DataFrame(index=range(both.num_rows))
            place = ids.groupby(keys, dropna=False, sort=False).cumcount().to_numpy() if keys else np.arange(both.num_rows)
            kept = both.filter(pa.array(place < n)).combine_chunks()
        if kept is not None:
            yield from kept.to_batches()

    part = df.mapInArrow(run, StructType(df.schema.fields))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return part.withColumn("_nth", nth).where(F.col("_nth") <= n).select(names)


def numbered(df: DataFrame, order: list[str], number: str = "number", start: int = 0) -> DataFrame:
    """``df`` with running numbers by ``order``, which must tell all rows apart: ranges are sorted each by itself, and their sizes give where each begins."""
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stored(sorted_.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    sizes = held.groupBy("_range").agg(F.count("*").alias("_size"))
    # one row a range
    begins = sizes.select("_range", (F.sum("_size").over(Window.orderBy("_range")) - F.col("_size")).alias("_begin"))
    return held.join(F.broadcast(begins), "_range").withColumn(number, F.col("_begin") + F.col("_place") + start).drop("_range", "_place", "_begin")
