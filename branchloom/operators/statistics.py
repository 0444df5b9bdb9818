"""Multiple testing, rank tests and model choice over relations."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def bh_adjust(df: DataFrame, p: str, groups: list[str], ties: list[str], out: str = "q_value") -> DataFrame:
    """Benjamini-Hochberg: q is the least p * m / rank of this and all larger p values, at most 1. Ties are ranked by ``ties``; groups are test families of moderate size."""
    up = Window.partitionBy(*groups).orderBy(p, *ties)
    raw = df.withColumns({"_m": F.count(F.lit(1)).over(Window.partitionBy(*groups)), "_rank": F.row_number().over(up)}).withColumn("_raw", F.col(p) * F.col("_m") / F.col("_rank"))
    down = Window.partitionBy(*groups).orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    return raw.withColumn(out, F.least(F.lit(1.0), F.min("_raw").over(down))).drop("_m", "_rank", "_raw")


@F.pandas_udf(T.DoubleType())
def chi_square_sf1(x: pd.Series) -> pd.Series:
    """Survival function of a chi-square variable with one degree of freedom."""
    v = pd.to_numeric(x).to_numpy(dtype=float)
    out = np.full(len(v), np.nan)
    ok = np.isfinite(v)
    r = np.sqrt(np.maximum(v[ok], 0.0) / 2)
    out[ok] = np.where(v[ok] <= 0, 1.0, np.frompyfunc(math.erfc, 1, 1)(r).astype(float))
    return pd.Series(out).where(~np.isnan(out), None)


def likelihood_ratio(null: Column, alternative: Column) -> Column:
    """Twice the gain in log likelihood; tiny negative gains are 0, larger ones give null."""
    gain = alternative - null
    return F.when(gain >= -1e-7, 2 * F.greatest(gain, F.lit(0.0)))


def bootstrap_p(exceeding: Column, replicates: Column) -> Column:
    return (exceeding + 1) / (replicates + 1)
