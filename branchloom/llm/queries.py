"""Queries of the training-data problems and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchloom.functions.values import key
from branchloom.llm.components import connected_components
from branchloom.llm.mixing import Mixture, mix
from branchloom.llm.packing import pack, sized_on_curve
from branchloom.llm.tokens import token_count
from branchloom.llm.topn import top_n
from branchloom.llm.truncation import find_truncated
from branchloom.plans.lineage import collect_bounded, materialize

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _k(c: str) -> str:
    return f"CASE WHEN lower(trim({c}, ' \t\r\n')) NOT IN ('', '.', 'na') THEN lower(trim({c}, ' \t\r\n')) END"


# --- 3: groups -------------------------------------------------------------

#: Sorts after every id, so that a homology node is never the smallest of a group that has an occurrence.
_HUB = "\U0010ffff"


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """A homology_id is a node of its own, tied to each occurrence it names, so no pairs within one are formed."""
    m = _table(spark, d, "segment_matches").filter(key("match_status") == "mapped").select(key("query_occurrence_id").alias("a"), key("subject_occurrence_id").alias("b"))
    h = _table(spark, d, "segment_homology").select(key("occurrence_id").alias("a"), F.concat(F.lit(_HUB), key("homology_id")).alias("b"))
    groups = connected_components(m.unionByName(h), "a", "b")
    members = groups.filter(~F.col("node").startswith(_HUB))
    tied = members.filter("node <> root")
    return tied.unionByName(tied.select(F.col("root").alias("node"), "root").distinct()).select(F.col("node").alias("occurrence_id"), F.col("root").alias("group_id"))


@query
def p3_group_sizes(spark: SparkSession, d: str) -> DataFrame:
    sizes = p3_found(spark, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("members"))
    return sizes.groupBy("members").agg(F.count(F.lit(1)).alias("n_groups"))


_TIES = f"""e AS (SELECT {_k('query_occurrence_id')} AS a, {_k('subject_occurrence_id')} AS b FROM segment_matches WHERE lower(trim(match_status, ' \t\r\n')) = 'mapped'
  UNION ALL SELECT {_k('occurrence_id')}, chr(1114111) || {_k('homology_id')} FROM segment_homology),
both_ AS (SELECT DISTINCT a, b FROM (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) WHERE a IS NOT NULL AND b IS NOT NULL AND a <> b),
walk AS (SELECT a AS id, a AS root FROM both_ UNION SELECT n.b, w.root FROM walk w JOIN both_ n ON n.a = w.id),
groups_ AS (SELECT id, min(root) AS group_id FROM walk WHERE root NOT LIKE chr(1114111) || '%' GROUP BY id),
found AS (SELECT id AS occurrence_id, group_id, count(*) OVER (PARTITION BY group_id) AS n FROM groups_ WHERE id NOT LIKE chr(1114111) || '%')"""
SQL["p3_found"] = f"WITH RECURSIVE {_TIES} SELECT occurrence_id, group_id FROM found WHERE n > 1"
SQL["p3_group_sizes"] = f"WITH RECURSIVE {_TIES} SELECT n AS members, count(DISTINCT group_id) AS n_groups FROM found WHERE n > 1 GROUP BY n"


# --- 5: top N --------------------------------------------------------------

_BEST = 3


def _best(spark: SparkSession, d: str) -> DataFrame:
    m = _table(spark, d, "segment_matches").filter(key("match_status") == "mapped")
    return top_n(m.select(key("query_occurrence_id").alias("query_occurrence_id"), key("match_id").alias("match_id"), "total_score"), "query_occurrence_id", "total_score", "match_id", _BEST)


@query
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("query_occurrence_id", "match_id")


@query
def p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("query_occurrence_id", "match_id", F.round("total_score", 6).alias("total_score"), F.col("rank").cast("bigint").alias("rank"))


_RANKED = f"""SELECT query_occurrence_id, match_id, round(total_score, 6) + 0.0 AS total_score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_occurrence_id ORDER BY total_score DESC, match_id) AS rank FROM (
    SELECT DISTINCT {_k('query_occurrence_id')} AS query_occurrence_id, {_k('match_id')} AS match_id, total_score FROM segment_matches
    WHERE lower(trim(match_status, ' \t\r\n')) = 'mapped' AND total_score IS NOT NULL AND NOT isnan(total_score))
  WHERE query_occurrence_id IS NOT NULL AND match_id IS NOT NULL) WHERE rank <= 3"""
SQL["p5_found"] = f"SELECT query_occurrence_id, match_id FROM ({_RANKED})"
SQL["p5_ranked"] = _RANKED


# --- 7: containers ---------------------------------------------------------


def _packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = {key_: cap for key_, cap in ((r.container.strip().lower(), r.capacity_tokens) for r in collect_bounded(_table(spark, d, "container_sizes"), 1000, "container_sizes") if r.container and r.capacity_tokens and r.capacity_tokens > 0)}
    sized = materialize(sized_on_curve(_table(spark, d, "documents"), "doc_id", "text"), "sized")
    return pack(sized, kinds)


@query
def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d).withColumnRenamed("item", "doc_id")


@query
def p7_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers used, tokens placed and share of the space filled per kind of container."""
    p = _packed(spark, d).groupBy("container", "capacity_tokens", "container_no").agg(F.sum("n_tokens").alias("used"), F.count(F.lit(1)).alias("pieces"))
    return p.filter("container_no IS NOT NULL").groupBy("container", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("pieces").alias("n_pieces"), F.sum("used").alias("n_tokens")).withColumn("fill_share", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens")), 6))


# --- 8: mixture ------------------------------------------------------------

#: A source is prose if this share of its texts closes with a sentence mark, else it is records.
PROSE_SHARE = 0.25
#: Sources and targets the driver takes.
MAX_SOURCES = 10_000


def _domains(sized: DataFrame) -> dict[str, str]:
    """The upper level of the budget tree, measured on all texts: the form most texts of a source have."""
    form = sized.filter("source IS NOT NULL AND n_tokens > 0").groupBy("source").agg(F.avg(F.col("closed").cast("int")).alias("share"))
    return {r.source: "prose" if r.share >= PROSE_SHARE else "records" for r in collect_bounded(form, MAX_SOURCES, "sources of documents")}


def _mixture(spark: SparkSession, d: str, whole_corpus: bool = False) -> Mixture:
    """``whole_corpus``: the total is all tokens of the target sources, so that small sources saturate and others fill in; else the largest total at which none runs short."""
    closed = F.col("text").rlike(r"[.!?]\s*$").alias("closed")
    docs = _table(spark, d, "documents").select(F.col("doc_id").alias("item"), key("source").alias("source"), key("lang").alias("language"), token_count(F.col("text"), spark).alias("n_tokens"), closed)
    sized = materialize(docs, "sized")
    targets = [(r.source, r.target_share, r.max_repeats) for r in collect_bounded(_table(spark, d, "mix_targets").select(key("source").alias("source"), "target_share", "max_repeats"), MAX_SOURCES, "mix_targets")]
    total = (sized.filter(F.col("source").isin([s for s, _, _ in targets if s])).agg(F.sum("n_tokens")).first()[0] or 0) if whole_corpus else None
    return mix(sized.drop("closed"), targets, _domains(sized), total)


@query
def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).rows.withColumnRenamed("item", "doc_id")


@query
def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d).shares


@query
def p8_large_mixture(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as the corpus: small sources reach their repeats, and what they lack goes to siblings before ancestors."""
    return _mixture(spark, d, True).rows.withColumnRenamed("item", "doc_id")


@query
def p8_large_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d, True).shares


# --- 9: texts cut off ------------------------------------------------------


@query
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text", key("source").alias("source"))
    return find_truncated(docs, "doc_id", "text", "source").documents.filter("truncated").select(F.col("item").alias("doc_id")).distinct()


@query
def p9_sources(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "text", key("source").alias("source"))
    return find_truncated(docs, "doc_id", "text", "source").sources
