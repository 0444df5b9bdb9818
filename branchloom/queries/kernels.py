"""Queries that run kernels per pair or per group."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F

from branchloom.functions import sequence
from branchloom.operators.kernels import affine_global, best_chain
from branchloom.queries.registry import Registry
from branchloom.queries.views import matches, placed

query = Registry()
C = F.col


@query()
def short_alignment(spark, d):
    """Affine global scores of the sequences spelled by the ids of mapped pairs; each distinct pair of sequences is aligned once."""
    m = matches(spark, d).filter("status = 'mapped' AND q IS NOT NULL AND t IS NOT NULL")
    pairs = m.select("match_id", sequence.from_text(C("q")).alias("a"), sequence.from_text(C("t")).alias("b"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(score=pd.array([affine_global(a, b) for a, b in zip(x["a"], x["b"])], dtype="Int64"))

    scored = pairs.select("a", "b").distinct().repartition("a", "b").mapInPandas(run, "a string, b string, score bigint")
    return pairs.join(scored, ["a", "b"]).select("match_id", "score", F.when(C("score").isNull(), "too_large").otherwise("aligned").alias("alignment_status"))


@query()
def chain_score(spark, d):
    """Best order-preserving chain of mapped matches per pair of copies, by a score that isn't a nucleotide scheme, so only best chains are kept; a group is bounded by the occurrences of two copies."""
    p = placed(spark, d).select("occ", "copy", F.when(C("strand") == "-", -C("e")).otherwise(C("s")).alias("x"))
    m = matches(spark, d).filter("status = 'mapped' AND total_score IS NOT NULL").groupBy("q", "t").agg(F.max("total_score").alias("score"))
    j = m.join(p.select(C("occ").alias("q"), C("copy").alias("left_copy"), C("x")), "q").join(p.select(C("occ").alias("t"), C("copy").alias("right_copy"), C("x").alias("y")), "t").filter("left_copy <> right_copy")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["x", "y", "score"])
        best, kept, must = best_chain(g["x"].to_numpy(), g["y"].to_numpy(), g["score"].to_numpy(), "local_score")
        return pd.DataFrame({"left_copy": [g["left_copy"].iloc[0]], "right_copy": [g["right_copy"].iloc[0]], "candidates": [len(g)], "best": [round(best, 6)], "retained": [int(kept.sum())], "mandatory": [int(must.sum())]})

    return j.select("left_copy", "right_copy", "x", "y", "score").groupBy("left_copy", "right_copy").applyInPandas(run, "left_copy string, right_copy string, candidates bigint, best double, retained bigint, mandatory bigint")


QUERIES, SQL = query.queries, query.sql
