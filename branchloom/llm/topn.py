"""The N highest-scoring items of every group, whatever the groups' sizes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from branchloom.plans.lineage import materialize, release

#: A group is heavy if it has more rows than this share of what a task gets on average.
HEAVY_SHARE = 0.5
#: Groups up to this size are light in any case.
LIGHT_ROWS = 1_000
#: Score ranges, and hash parts of each range, of a heavy group.
RANGES = 16
PARTS = 4


def top_n(df: DataFrame, group: str, score: str, item: str, n: int, heavy_share: float = HEAVY_SHARE, light_rows: int = LIGHT_ROWS, ranges: int = RANGES, parts: int = PARTS) -> DataFrame:
    """group, item, score and rank (1..n) of the ``n`` best items per group; of equal scores the smaller item comes first.

    Exact counts split the groups: heavy is one with more than ``heavy_share``
    of the rows an even split would give a shuffle partition, so there are
    never more heavy groups than partitions / ``heavy_share``. Light groups go
    through an ordinary window whose limit also runs before the shuffle. A
    heavy group is cut by salts that are ranges of its own scores (its
    quantiles) and hash parts of equal or near scores; each salt sorts its own
    rows and passes on its best n, and only those meet in the last window.

    Defined results: rows with a null group, item or score, or a NaN score,
    take no part; a row that comes more than once counts once; -0.0 equals
    0.0; a group with fewer than n items gives what it has; no rows give none.
    """
    rows = df.select(F.col(f"`{group}`").alias("g"), F.col(f"`{item}`").alias("i"), (F.col(f"`{score}`").cast("double") + F.lit(0.0)).alias("s")).filter("g IS NOT NULL AND i IS NOT NULL AND s IS NOT NULL AND NOT isnan(s)")
    best = [F.desc("s"), F.asc("i")]
    counts = materialize(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")), "group_sizes")
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    found = counts.filter(F.col("n") > max(light_rows, int(total / partitions * heavy_share))).collect()  # at most partitions / heavy_share rows
    release(counts)
    heavy = rows.sparkSession.createDataFrame(found, counts.schema) if found else None

    def ranked(d: DataFrame, *by: str) -> DataFrame:
        # dense rank: copies of a row share a place, and the distinct after it takes them together
        w = Window.partitionBy(*by).orderBy(*best)
        return d.withColumn("rank", F.dense_rank().over(w)).filter(F.col("rank") <= n).distinct()

    if heavy is None:
        out = ranked(rows, "g")
    else:
        small = F.broadcast(heavy.select(F.col("g").alias("_g")))
        light = rows.join(small, F.col("g") == F.col("_g"), "left_anti")
        hot = rows.join(small, F.col("g") == F.col("_g"), "left_semi")
        cuts = hot.groupBy("g").agg(F.percentile_approx("s", F.array(*[F.lit((k + 1) / ranges) for k in range(ranges - 1)]), F.lit(10_000)).alias("_cuts"))
        local = rows.sparkSession.createDataFrame(cuts.collect(), cuts.schema).withColumnRenamed("g", "_g")  # one row per heavy group
        salted = hot.join(F.broadcast(local), F.col("g") == F.col("_g")).withColumns({"_range": F.size(F.filter("_cuts", lambda c: c < F.col("s"))), "_part": F.pmod(F.xxhash64("i"), F.lit(parts))}).select("g", "i", "s", "_range", "_part")
        few = ranked(salted, "g", "_range", "_part").select("g", "i", "s")
        out = ranked(light, "g").unionByName(ranked(few, "g"))
    return out.select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), "rank")
