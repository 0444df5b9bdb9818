"""Cleaned relations the operator queries start from, for Spark and as SQL text for the check.

A row delivered more than once is one row; ids and words are trimmed and in
lower case; missing texts are null; NaN is null; backward intervals are turned.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchloom.functions.values import MINUS, PLUS, key, strand_sign
from branchloom.queries.tables import table

SCORES = ["alignment_score", "left_context_score", "right_context_score", "left_boundary_score", "right_boundary_score", "size_ratio", "total_score"]


def k(c: str) -> str:
    t = f"lower(trim({c}, ' \t\r\n'))"
    return f"CASE WHEN {t} NOT IN ('', '.', 'na') THEN {t} END"


def sign(c: str) -> str:
    words = lambda w: ", ".join(f"'{x}'" for x in w)
    t = f"lower(trim({c}, ' \t\r\n'))"
    return f"CASE WHEN {t} IN ({words(PLUS)}) THEN '+' WHEN {t} IN ({words(MINUS)}) THEN '-' END"


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "segment_occurrences").select(
        key("occurrence_id").alias("occ"), key("family_id").alias("family"), key("species").alias("species"), key("gene_copy_id").alias("copy"), key("transcript_id").alias("tx"), key("segment_id").alias("segment"), key("contig").alias("contig"),
        F.least("start", "end").alias("s"), F.greatest("start", "end").alias("e"), strand_sign("strand").alias("strand"), key("role").alias("role"), key("presence_status").alias("presence"), key("boundary_state").alias("boundary"), key("evidence").alias("evidence"), "loaded_at", "retired_at",
    ).distinct()


OCC = f"""occ AS (SELECT DISTINCT {k('occurrence_id')} AS occ, {k('family_id')} AS family, {k('species')} AS species, {k('gene_copy_id')} AS copy, {k('transcript_id')} AS tx, {k('segment_id')} AS segment, {k('contig')} AS contig,
  least("start", "end") AS s, greatest("start", "end") AS e, {sign('strand')} AS strand, {k('role')} AS role, {k('presence_status')} AS presence, {k('boundary_state')} AS boundary, {k('evidence')} AS evidence, loaded_at, retired_at FROM segment_occurrences)"""


def placed(spark: SparkSession, d: str) -> DataFrame:
    """One row per occurrence that has all coordinates: the version loaded last, ties by content."""
    o = occurrences(spark, d).dropna(subset=["occ", "copy", "contig", "strand", "s", "e"])
    rest = ["species", "family", "tx", "segment", "contig", "strand", "s", "e", "role", "presence", "boundary", "evidence", "copy"]
    return o.groupBy("occ").agg(F.max(F.struct("loaded_at", *[F.coalesce(F.col(c), F.lit("")).alias(c) if c not in ("s", "e") else F.col(c) for c in rest])).alias("v")).select("occ", *[F.when(F.col(f"v.{c}") != "", F.col(f"v.{c}")).alias(c) if c not in ("s", "e") else F.col(f"v.{c}").alias(c) for c in rest])


_REST = ["species", "family", "tx", "segment", "contig", "strand", "s", "e", "role", "presence", "boundary", "evidence", "copy"]
PLACED = OCC + ", placed AS (SELECT occ, " + ", ".join(f"nullif({c}, '') AS {c}" if c not in ("s", "e") else c for c in _REST) + " FROM (SELECT *, row_number() OVER (PARTITION BY occ ORDER BY loaded_at DESC, " + ", ".join(f"coalesce({c}, '') DESC" if c not in ("s", "e") else f"{c} DESC" for c in _REST) + ") AS rn FROM occ WHERE occ IS NOT NULL AND copy IS NOT NULL AND contig IS NOT NULL AND strand IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL) WHERE rn = 1)"


def matches(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "segment_matches")
    return m.select(key("match_id").alias("match_id"), key("query_occurrence_id").alias("q"), key("subject_occurrence_id").alias("t"), *[F.when(~F.isnan(c), F.col(c)).alias(c) for c in SCORES], key("match_status").alias("status"), key("splice_site_status").alias("splice")).distinct()


MATCH = f"m AS (SELECT DISTINCT {k('match_id')} AS match_id, {k('query_occurrence_id')} AS q, {k('subject_occurrence_id')} AS t, " + ", ".join(f"CASE WHEN NOT isnan({c}) THEN {c} END AS {c}" for c in SCORES) + f", {k('match_status')} AS status, {k('splice_site_status')} AS splice FROM segment_matches)"


def homology(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "segment_homology")
    return h.select("record_no", key("homology_id").alias("homology"), key("occurrence_id").alias("occ"), key("source_label").alias("label"), key("support_type").alias("support"), F.col("comparable_start").alias("cs"), F.col("comparable_end").alias("ce"), key("confidence").alias("confidence"), "loaded_at").distinct()


HOM = f"h AS (SELECT DISTINCT record_no, {k('homology_id')} AS homology, {k('occurrence_id')} AS occ, {k('source_label')} AS label, {k('support_type')} AS support, comparable_start AS cs, comparable_end AS ce, {k('confidence')} AS confidence, loaded_at FROM segment_homology)"


def features(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "raw_gene_features")
    return f.select(key("family_id").alias("family"), key("species").alias("species"), key("gene_copy_id").alias("copy"), key("gene_id").alias("gene"), key("seqid").alias("seqid"), key("source").alias("source"), key("type").alias("type"), F.least("start", "end").alias("s"), F.greatest("start", "end").alias("e"), strand_sign("strand").alias("strand"), "phase", key("id").alias("id"), key("parent").alias("parent"), key("parents").alias("parents"), key("ownership").alias("ownership"), "attrs").distinct()


FEAT = f"""f AS (SELECT DISTINCT {k('family_id')} AS family, {k('species')} AS species, {k('gene_copy_id')} AS copy, {k('gene_id')} AS gene, {k('seqid')} AS seqid, {k('source')} AS source, {k('type')} AS type, least("start", "end") AS s, greatest("start", "end") AS e, {sign('strand')} AS strand, phase, {k('id')} AS id, {k('parent')} AS parent, {k('parents')} AS parents, {k('ownership')} AS ownership, attrs FROM raw_gene_features)"""


def adjacencies(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "physical_adjacencies")
    return a.select("record_no", key("adjacency_id").alias("adjacency"), key("family_id").alias("family"), key("species").alias("species"), key("gene_copy_id").alias("copy"), key("left_occurrence_id").alias("l"), key("right_occurrence_id").alias("r"), key("adjacency_status").alias("status"), key("evidence").alias("evidence"), "loaded_at").distinct()


ADJ = f"a AS (SELECT DISTINCT record_no, {k('adjacency_id')} AS adjacency, {k('family_id')} AS family, {k('species')} AS species, {k('gene_copy_id')} AS copy, {k('left_occurrence_id')} AS l, {k('right_occurrence_id')} AS r, {k('adjacency_status')} AS status, {k('evidence')} AS evidence, loaded_at FROM physical_adjacencies)"


def tree(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "species_tree")
    return t.select(key("node_id").alias("node"), key("parent_id").alias("up"), key("label").alias("label"), F.when(~F.isnan("branch_length") & (F.col("branch_length") >= 0), F.col("branch_length")).alias("length")).filter("node IS NOT NULL").groupBy("node").agg(F.min("up").alias("up"), F.min("label").alias("label"), F.min("length").alias("length"))


TREE = f"tr AS (SELECT node, min(up) AS up, min(label) AS label, min(length) AS length FROM (SELECT {k('node_id')} AS node, {k('parent_id')} AS up, {k('label')} AS label, CASE WHEN NOT isnan(branch_length) AND branch_length >= 0 THEN branch_length END AS length FROM species_tree) WHERE node IS NOT NULL GROUP BY node)"
