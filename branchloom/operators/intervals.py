"""Overlapping and gapped intervals: continuous periods and the gaps between them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from branchloom.plans import skew


@dataclass
class Periods:
    """``periods``: keys, start, end, n_intervals. ``gaps``: keys, gap_start, gap_end."""

    periods: DataFrame
    gaps: DataFrame


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str, hot_rows: int = skew.HOT_ROWS, chunks: int = skew.SALTS) -> Periods:
    """Merge closed integer intervals per entity and list what they leave uncovered.

    Rows are sorted by start per entity; each start is compared with the
    running maximum of the previous ends; a start beyond it opens an island;
    the islands' labels are carried on and aggregated to periods. An entity
    with more than ``hot_rows`` distinct starts is cut into chunks along its
    starts, and one carried maximum per chunk joins the chunks again.

    Defined results: a row with a null key, start or end takes no part; an
    interval written backwards is the same interval turned round; touching
    intervals (end + 1 = start) form one period; repeated and equal intervals
    count once in the coverage but each in ``n_intervals``; no rows give no
    periods. Further columns of ``df`` are ignored.
    """
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(
        *[F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)],
        F.least(f"`{start}`", f"`{end}`").cast("bigint").alias("s"),
        F.greatest(f"`{start}`", f"`{end}`").cast("bigint").alias("e"),
        (F.col(f"`{start}`").isNotNull() & F.col(f"`{end}`").isNotNull()).alias("whole"),
    ).filter("whole").dropna(subset=names)
    # one row per entity and start: equal starts can't pile up in one task
    starts = rows.groupBy(*names, "s").agg(F.max("e").alias("e"), F.count(F.lit(1)).alias("n"))
    d, carried = skew.chunked(starts, names, "s", hot_rows, chunks)
    d = skew.running_max(d, names, [F.col("s")], F.col("e"), "reach", carried)
    gaps = d.filter(F.col("s") > F.col("reach") + 1).select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], (F.col("reach") + 1).alias("gap_start"), (F.col("s") - 1).alias("gap_end")
    )
    opens = F.when(F.col("reach").isNull() | (F.col("s") > F.col("reach") + 1), F.col("s"))
    labelled = skew.running_max(d, names, [F.col("s")], opens, "island", carried, inclusive=True)
    periods = labelled.groupBy(*names, "island").agg(F.max("e").alias("e"), F.sum("n").alias("n")).select(
        *[F.col(n).alias(k) for k, n in zip(keys, names)], F.col("island").alias("start"), F.col("e").alias("end"), F.col("n").alias("n_intervals")
    )
    return Periods(periods, gaps)
