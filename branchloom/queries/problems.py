"""Queries of the general data problems: orphans, intervals, hierarchies, nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchloom.functions.values import key, strand_sign
from branchloom.operators.hierarchy import descendants, resolve_hierarchy
from branchloom.operators.intervals import Periods, merge_intervals
from branchloom.operators.nested import SPAN, TEXT, ValueArray, flatten, whole_json
from branchloom.operators.references import orphan_references, orphan_report
from branchloom.queries.tables import table

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


# DuckDB form of functions.values.key
K = "CASE WHEN lower(trim({0}, ' \t\r\n')) NOT IN ('', '.', 'na') THEN lower(trim({0}, ' \t\r\n')) END"


def k(c: str) -> str:
    return K.format(c)


# --- 1: references ---------------------------------------------------------


def _references(spark: SparkSession, d: str) -> DataFrame:
    h = table(spark, d, "segment_homology").select(F.lit("segment_homology").alias("ref_table"), "record_no", F.lit("occurrence_id").alias("ref_field"), key("occurrence_id").alias("ref_id"), F.col("loaded_at").alias("at"))
    a = table(spark, d, "physical_adjacencies").select("record_no", "loaded_at", F.explode(F.create_map(F.lit("left_occurrence_id"), key("left_occurrence_id"), F.lit("right_occurrence_id"), key("right_occurrence_id"))).alias("ref_field", "ref_id"))
    return h.unionByName(a.select(F.lit("physical_adjacencies").alias("ref_table"), "record_no", "ref_field", "ref_id", F.col("loaded_at").alias("at"))).filter("ref_id IS NOT NULL")


def _parents(spark: SparkSession, d: str) -> DataFrame:
    own = [key("occurrence_id").alias("parent_id"), F.col("loaded_at").alias("since"), F.col("retired_at").alias("until")]
    return table(spark, d, "segment_occurrences").select(*own).unionByName(table(spark, d, "reference_occurrences").select(*own))


PAYLOAD = ["ref_table", "record_no", "ref_field"]


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return orphan_references(_references(spark, d), _parents(spark, d), PAYLOAD).select("ref_table", "record_no", "ref_field").distinct()


@query
def p1_orphans_per_month(spark: SparkSession, d: str) -> DataFrame:
    refs = _references(spark, d).distinct()
    bad = orphan_references(refs, _parents(spark, d), PAYLOAD)
    return orphan_report(refs, bad, ["ref_table", "ref_field"])


_REFS = f"""refs AS (SELECT DISTINCT * FROM (
  SELECT 'segment_homology' AS ref_table, record_no, 'occurrence_id' AS ref_field, {k('occurrence_id')} AS ref_id, loaded_at AS at_ FROM segment_homology
  UNION ALL SELECT 'physical_adjacencies', record_no, 'left_occurrence_id', {k('left_occurrence_id')}, loaded_at FROM physical_adjacencies
  UNION ALL SELECT 'physical_adjacencies', record_no, 'right_occurrence_id', {k('right_occurrence_id')}, loaded_at FROM physical_adjacencies) WHERE ref_id IS NOT NULL),
parents AS (SELECT {k('occurrence_id')} AS parent_id, loaded_at AS since, retired_at AS until FROM segment_occurrences
  UNION ALL SELECT {k('occurrence_id')}, loaded_at, retired_at FROM reference_occurrences),
bad AS (SELECT * FROM refs r WHERE NOT EXISTS (SELECT 1 FROM parents p WHERE p.parent_id = r.ref_id AND p.since <= r.at_ AND (p.until IS NULL OR p.until > r.at_)))"""
SQL["p1_found"] = f"WITH {_REFS} SELECT DISTINCT ref_table, record_no, ref_field FROM bad"
SQL["p1_orphans_per_month"] = f"""WITH {_REFS}, b AS (SELECT ref_table, ref_field, strftime(at_, '%Y-%m') AS month, count(*) AS n FROM bad GROUP BY ALL),
r AS (SELECT ref_table, ref_field, strftime(at_, '%Y-%m') AS month, count(*) AS n FROM refs GROUP BY ALL)
SELECT r.ref_table, r.ref_field, r.month, r.n AS n_refs, coalesce(b.n, 0) AS n_orphans, round(coalesce(b.n, 0) / r.n, 6) AS orphan_share
FROM r LEFT JOIN b ON r.ref_table = b.ref_table AND r.ref_field = b.ref_field AND r.month IS NOT DISTINCT FROM b.month"""


# --- 2: intervals ----------------------------------------------------------


def _coverage(spark: SparkSession, d: str) -> Periods:
    rows = table(spark, d, "segment_occurrences").select(key("gene_copy_id").alias("gene_copy_id"), key("contig").alias("contig"), strand_sign("strand").alias("strand"), "start", "end")
    return merge_intervals(rows, ["gene_copy_id", "contig", "strand"], "start", "end")


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).gaps


@query
def p2_periods(spark: SparkSession, d: str) -> DataFrame:
    return _coverage(spark, d).periods.select("gene_copy_id", "contig", "strand", F.col("start").alias("period_start"), F.col("end").alias("period_end"), "n_intervals")


_INTERVALS = f"""rows_ AS (SELECT {k('gene_copy_id')} AS gene_copy_id, {k('contig')} AS contig,
  CASE WHEN lower(trim(strand, ' \t\r\n')) IN ('+', '1', '+1', 'plus', 'forward', 'fwd', 'positive', 'sense') THEN '+'
       WHEN lower(trim(strand, ' \t\r\n')) IN ('-', '-1', '−', '−1', 'minus', 'reverse', 'rev', 'negative', 'antisense') THEN '-' END AS strand,
  least("start", "end") AS s, greatest("start", "end") AS e FROM segment_occurrences WHERE "start" IS NOT NULL AND "end" IS NOT NULL),
sorted_ AS (SELECT *, max(e) OVER (PARTITION BY gene_copy_id, contig, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach
  FROM rows_ WHERE gene_copy_id IS NOT NULL AND contig IS NOT NULL AND strand IS NOT NULL)"""
SQL["p2_found"] = f"WITH {_INTERVALS} SELECT gene_copy_id, contig, strand, reach + 1 AS gap_start, s - 1 AS gap_end FROM sorted_ WHERE s > reach + 1"
SQL["p2_periods"] = f"""WITH {_INTERVALS}, labelled AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY gene_copy_id, contig, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM sorted_)
SELECT gene_copy_id, contig, strand, min(s) AS period_start, max(e) AS period_end, count(*) AS n_intervals FROM labelled GROUP BY gene_copy_id, contig, strand, island"""


# --- 4: hierarchies --------------------------------------------------------


def _resolved(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    """Both tables in one go: a node is the pair of its table and its id."""

    def pairs(name: str, node: str, parent: str) -> DataFrame:
        pair = lambda c: F.when(key(c).isNotNull(), F.struct(F.lit(name).alias("t"), key(c).alias("id")))
        return table(spark, d, name).select(pair(node).alias("node"), pair(parent).alias("up"))

    r = resolve_hierarchy(pairs("raw_gene_features", "id", "parent").unionByName(pairs("species_tree", "node_id", "parent_id")), "node", "up", with_path)
    return r.select(F.col("node_id.t").alias("source_table"), F.col("node_id.id").alias("node_id"), F.col("root_id.id").alias("root_id"), "depth", *([F.transform("path", lambda x: x["id"]).alias("path")] if with_path else []))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, False).select("source_table", "node_id", "root_id", "depth")


@query
def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d, True).select("source_table", "node_id", "depth", F.array_join("path", "/").alias("path"))


@query
def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """One row for each node and each node below it; a node without any has no row here."""
    return descendants(_resolved(spark, d, True), ["source_table"])


@query
def p4_descendant_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row for each node, with zeros where nothing is below it and nulls for nodes on or below circles."""
    r = _resolved(spark, d, True)
    n = descendants(r, ["source_table"]).groupBy("source_table", F.col("ancestor_id").alias("node_id")).agg(F.count(F.lit(1)).alias("n_descendants"), F.count_if(F.col("distance") == 1).alias("n_children"), F.max("distance").alias("height"))
    counts = [F.when(F.col("depth") >= 0, F.coalesce(c, F.lit(0))).alias(c) for c in ("n_descendants", "n_children", "height")]
    return r.select("source_table", "node_id", "depth").join(n, ["source_table", "node_id"], "left").select("source_table", "node_id", *counts)


_FOREST = f"""links AS (SELECT t, id, min(up) AS up FROM (SELECT 'raw_gene_features' AS t, {k('id')} AS id, {k('parent')} AS up FROM raw_gene_features
  UNION ALL SELECT 'species_tree', {k('node_id')}, {k('parent_id')} FROM species_tree) WHERE id IS NOT NULL GROUP BY t, id),
down AS (SELECT l.t, l.id, l.id AS root, 0::BIGINT AS depth, l.id AS path FROM links l LEFT JOIN links p ON p.t = l.t AND p.id = l.up WHERE p.id IS NULL
  UNION ALL SELECT l.t, l.id, d.root, d.depth + 1, d.path || '/' || l.id FROM down d JOIN links l ON l.t = d.t AND l.up = d.id)"""
_LOST = """lost AS (SELECT * FROM links l WHERE NOT EXISTS (SELECT 1 FROM down d WHERE d.t = l.t AND d.id = l.id)),
walk AS (SELECT t, id AS start_id, id, up FROM lost UNION SELECT w.t, w.start_id, l.id, l.up FROM walk w JOIN lost l ON l.t = w.t AND l.id = w.up),
ring AS (SELECT DISTINCT t, start_id AS id FROM walk WHERE up = start_id),
low AS (SELECT w.t, w.start_id, min(w.id) AS root FROM walk w JOIN ring r ON r.t = w.t AND r.id = w.id GROUP BY ALL)"""
SQL["p4_found"] = f"""WITH RECURSIVE {_FOREST}, {_LOST}
SELECT t AS source_table, id AS node_id, root AS root_id, depth FROM down UNION ALL SELECT t, start_id, root, -1 FROM low"""
SQL["p4_paths"] = f"""WITH RECURSIVE {_FOREST} SELECT l.t AS source_table, l.id AS node_id, coalesce(d.depth, -1) AS depth, d.path FROM links l LEFT JOIN down d ON d.t = l.t AND d.id = l.id"""
_PAIRS = """pairs AS (SELECT d.t, l.up AS anc, d.id, 1::BIGINT AS distance FROM down d JOIN links l ON l.t = d.t AND l.id = d.id WHERE d.depth > 0
  UNION ALL SELECT p.t, l.up, p.id, p.distance + 1 FROM pairs p JOIN down d ON d.t = p.t AND d.id = p.anc JOIN links l ON l.t = d.t AND l.id = d.id WHERE d.depth > 0)"""
SQL["p4_descendants"] = f"""WITH RECURSIVE {_FOREST}, {_PAIRS} SELECT t AS source_table, anc AS ancestor_id, id AS descendant_id, distance FROM pairs"""
SQL["p4_descendant_counts"] = f"""WITH RECURSIVE {_FOREST}, {_PAIRS}, n AS (SELECT t, anc, count(*) AS n, count(*) FILTER (WHERE distance = 1) AS kids, max(distance) AS height FROM pairs GROUP BY ALL)
SELECT l.t AS source_table, l.id AS node_id, CASE WHEN d.id IS NOT NULL THEN coalesce(n, 0) END AS n_descendants, CASE WHEN d.id IS NOT NULL THEN coalesce(kids, 0) END AS n_children, CASE WHEN d.id IS NOT NULL THEN coalesce(height, 0) END AS height
FROM links l LEFT JOIN down d ON d.t = l.t AND d.id = l.id LEFT JOIN n ON n.t = l.t AND n.anc = l.id"""


# --- 6: nested records -----------------------------------------------------

VALUES = [ValueArray("span", "affected_spans", SPAN, pairs=True), ValueArray("consequence", "consequences", TEXT)]


def _units(spark: SparkSession, d: str) -> DataFrame:
    """One row per history_id: of rows with one id, the latest one, ties broken by content."""
    rows = table(spark, d, "exon_history").select("history_id", F.struct("computed_at", "events", "affected_spans", "consequences").alias("u"))
    return rows.groupBy("history_id").agg(F.max("u").alias("u")).select("history_id", "u.*")


def _flat(units: DataFrame):
    return flatten(units.select("history_id", F.expr(whole_json("events")).alias("doc")), "history_id", "doc", "steps", VALUES, wrapper="events")


@query
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    units = _units(spark, d)
    flat = _flat(units)
    text = "try_variant_get(object, '$.operation', 'string')"
    events = flat.objects.select(F.col("key").alias("history_id"), F.col("path").alias("event_path"), F.lit("event").alias("child_kind"), F.lit(0).alias("child_no"), F.expr(f"trim(BOTH ' \\t\\r\\n' FROM {text})").alias("child_value"))
    inner = flat.values.select(F.col("key").alias("history_id"), F.col("path").alias("event_path"), F.col("kind").alias("child_kind"), F.col("ordinal").alias("child_no"), F.col("value").alias("child_value"))
    whole = units.select(
        "history_id",
        F.explode(
            F.concat(
                F.expr("transform(filter(coalesce(affected_spans, array()), x -> x IS NOT NULL), (x, i) -> struct('span' AS child_kind, i AS child_no, concat(coalesce(CAST(get(x, 0) AS STRING), 'NA'), '-', coalesce(CAST(get(x, 1) AS STRING), 'NA')) AS child_value))"),
                F.expr("transform(filter(coalesce(consequences, array()), x -> x IS NOT NULL), (x, i) -> struct('consequence' AS child_kind, i AS child_no, trim(BOTH ' \\t\\r\\n' FROM x) AS child_value))"),
            )
        ).alias("c"),
    ).select("history_id", F.lit("").alias("event_path"), "c.child_kind", "c.child_no", "c.child_value")
    return events.unionByName(inner).unionByName(whole)


@query
def p6_events(spark: SparkSession, d: str) -> DataFrame:
    """The child table of events with its surrogate and parent keys and scalar fields."""
    o = _flat(_units(spark, d)).objects
    get = lambda name, kind: F.expr(f"try_variant_get(object, '$.{name}', '{kind}')")
    return o.select(
        F.col("key").alias("history_id"), F.col("path").alias("event_path"), F.col("parent_path").alias("parent_event_path"), F.col("ordinal").alias("event_no"), "depth",
        *[get(n, "string").alias(n) for n in ("parent", "child", "edit_key", "operation", "support", "molecular_mutation_count")],
        *[get(n, "bigint").alias(n) for n in ("start", "end", "minimum_count", "maximum_count")],
        F.expr("to_json(try_variant_get(object, '$.conditions', 'variant'))").alias("conditions"),
    )


@query
def p6_fields(spark: SparkSession, d: str) -> DataFrame:
    """Every other member of an event, nested ones flattened by the merged schema, with the event's surrogate key."""
    f = _flat(_units(spark, d)).fields
    return f.select(F.col("key").alias("history_id"), F.col("path").alias("event_path"), "field", "place", "value")


@query
def p6_schema(spark: SparkSession, d: str) -> DataFrame:
    """The merged schema found at each depth of nesting."""
    found = _flat(_units(spark, d)).schemas
    return spark.createDataFrame([(i, s) for i, s in enumerate(found)], "depth int, merged_schema string")
