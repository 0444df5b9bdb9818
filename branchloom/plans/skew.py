"""Hot keys: exact counts, salted joins and windows whose groups are cut in chunks.

A key is hot if it has more than ``hot_rows`` rows and is among the ``MAX_HOT``
largest. So the list may be collected and broadcast; a key that isn't on it
holds less than a MAX_HOT-th of all rows, which is less than a task's share
wherever that many keys are over ``hot_rows``, and stays exact.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 500_000
MAX_HOT = 10_000
SALTS = 32


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """Keys with more than ``hot_rows`` rows as a small local table ``keys + n``, or None if there are none.

    Null keys are never hot: they join nothing and form no group. A table
    known to have no more rows than that has no hot key.
    """
    known = getattr(df, "_branchloom_rows", None)
    if known is not None and known <= hot_rows:
        return None
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot_rows).dropna(subset=keys)
    rows = counts.orderBy(F.desc("n"), *keys).limit(MAX_HOT).collect()
    return df.sparkSession.createDataFrame(rows, counts.schema) if rows else None


def salted_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, how: str, hot_rows: int = HOT_ROWS, salts: int = SALTS, spread: str | None = None) -> DataFrame:
    """Equi-join whose left side may hold one key very often; ``right`` is unique by its key.

    Rows of hot left keys are spread over ``salts`` by a hash of ``spread``
    (default: all left columns) and the matching right rows are repeated once
    per salt. ``how`` is inner, left, left_semi or left_anti.
    """
    known = getattr(left, "_branchloom_rows", None)
    hot = None if known is not None and known <= hot_rows else hot_keys(left.select(F.col(left_key).alias("_hk")), ["_hk"], hot_rows)
    if hot is None:
        return left.join(right, left[left_key] == right[right_key], how)
    small = F.broadcast(hot.select("_hk", F.lit(True).alias("_hot")))
    spreader = F.xxhash64(F.col(spread)) if spread else F.xxhash64(*[F.col(c) for c in left.columns])
    a = left.join(small, left[left_key] == F.col("_hk"), "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(spreader, F.lit(salts)).cast("int")).otherwise(0)).drop("_hk", "_hot")
    b = right.join(small, right[right_key] == F.col("_hk"), "left").withColumn("_rsalt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hk", "_hot")
    return a.join(b, (a[left_key] == b[right_key]) & (a["_salt"] == b["_rsalt"]), how).drop("_salt", "_rsalt")


def chunked(df: DataFrame, keys: list[str], order: str, hot_rows: int = HOT_ROWS, chunks: int = SALTS) -> tuple[DataFrame, bool]:
    """Add ``_chunk``: 0 for ordinary keys, else the position of ``order`` among the key's quantiles.

    Chunks of one key follow each other in ``order``, and rows with equal
    ``order`` share a chunk. ``_cut`` marks rows of hot keys. Also returns whether any key is hot.
    """
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return df.withColumns({"_chunk": F.lit(0), "_cut": F.lit(False)}), False
    names = [f"_k{i}" for i in range(len(keys))]
    hot = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names)])
    same = reduce(lambda a, b: a & b, [df[k] == hot[n] for k, n in zip(keys, names)])
    at = [F.lit((i + 1) / chunks) for i in range(chunks - 1)]
    cuts = df.join(F.broadcast(hot), same, "left_semi").groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)]).agg(F.percentile_approx(order, F.array(*at), F.lit(10_000)).alias("_cuts"))
    local = df.sparkSession.createDataFrame(cuts.collect(), cuts.schema)  # at most MAX_HOT rows
    same = reduce(lambda a, b: a & b, [df[k] == local[n] for k, n in zip(keys, names)])
    out = df.join(F.broadcast(local), same, "left")
    place = F.size(F.filter("_cuts", lambda x: x < F.col(order)))
    return out.withColumns({"_chunk": F.when(F.col("_cuts").isNull(), 0).otherwise(place), "_cut": F.col("_cuts").isNotNull()}).drop("_cuts", *names), True


def running_max(df: DataFrame, keys: list[str], order: list[Column], value: Column, out: str, carried: bool, inclusive: bool = False, split: list[str] | None = None) -> DataFrame:
    """Running maximum of ``value`` per key over rows that have ``_chunk``.

    Each chunk runs its own window. Where a key was cut (``carried``), the
    maximum of all earlier chunks is added from one small row per chunk. The
    current row takes part only if ``inclusive``. Nulls never win. ``split``
    names further columns that cut a chunk; every part must hold all rows
    whose value counts.
    """
    split = split or []
    w = Window.partitionBy(*keys, "_chunk", *split).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    d = df.withColumn("_v", value)
    own = d.withColumn(out, F.max("_v").over(w))
    if not carried:
        return own.drop("_v")
    names = [f"_k{i}" for i in range(len(keys))]
    per_chunk = d.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("_chunk").alias("_c")).agg(F.max("_v").alias("_m"))
    before = Window.partitionBy(*names).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.withColumn("_carry", F.max("_m").over(before)).filter("_c > 0").drop("_m")  # hot keys only: MAX_HOT x chunks rows at most
    same = reduce(lambda a, b: a & b, [own[k] == carry[n] for k, n in zip(keys, names)]) & (own["_chunk"] == carry["_c"])
    return own.join(F.broadcast(carry), same, "left").withColumn(out, F.greatest(out, "_carry")).drop("_carry", "_c", "_v", *names)
