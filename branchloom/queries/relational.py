"""Joins, aggregations, windows, orderings and set operations over the domain's relations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from branchloom.functions import scoring
from branchloom.operators.intervals import merge_intervals
from branchloom.operators.joins import densify, nearest_before, overlap_join, reciprocal_best, upsert
from branchloom.operators.statistics import bh_adjust
from branchloom.queries.registry import Registry, r6
from branchloom.queries.scalars import CONF, ROLE, STATE
from branchloom.queries.tables import table
from branchloom.queries.views import ADJ, FEAT, HOM, MATCH, OCC, PLACED, adjacencies, features, homology, k, matches, occurrences, placed

query = Registry()
C = F.col


def N():
    return F.count("*").alias("n")


# --- joins -----------------------------------------------------------------


@query(f"""WITH {OCC}, c AS (SELECT family, copy, count(*) AS n FROM (SELECT DISTINCT family, copy, occ FROM occ WHERE family IS NOT NULL AND copy IS NOT NULL AND occ IS NOT NULL) GROUP BY ALL)
SELECT family, ((sum(n) * sum(n) - sum(n * n)) / 2)::BIGINT AS pairs, count(*) AS copies FROM c GROUP BY family""")
def self_pairs_blocked(spark, d):
    """Candidate pairs per family between different copies, counted from copy sizes without forming them."""
    o = occurrences(spark, d).select("family", "copy", "occ").dropna().distinct()
    c = o.groupBy("family", "copy").agg(N())
    return c.groupBy("family").agg(((F.sum("n") * F.sum("n") - F.sum(C("n") * C("n"))) / 2).cast("bigint").alias("pairs"), F.count("*").alias("copies"))


@query(f"""WITH {PLACED} SELECT a.occ AS left_occ, b.occ AS right_occ, least(a.e, b.e) - greatest(a.s, b.s) + 1 AS overlap FROM placed a JOIN placed b ON a.copy = b.copy AND a.contig = b.contig AND a.strand = b.strand AND a.occ < b.occ AND a.s <= b.e AND b.s <= a.e""")
def overlap_pairs(spark, d):
    p = placed(spark, d).select("occ", "copy", "contig", "strand", "s", "e")
    pairs = overlap_join(p, p, ["copy", "contig", "strand"]).filter("occ < r_occ")
    return pairs.select(C("occ").alias("left_occ"), C("r_occ").alias("right_occ"), (F.least("e", "r_e") - F.greatest("s", "r_s") + 1).alias("overlap"))


@query(f"""WITH {PLACED}, {FEAT}, g AS (SELECT DISTINCT id, seqid, s, e FROM f WHERE type = 'gene' AND id IS NOT NULL AND seqid IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL)
SELECT occ, count(*) AS genes, min(id) AS first_gene FROM placed p JOIN g ON g.seqid = p.contig AND p.s BETWEEN g.s AND g.e GROUP BY occ""")
def stab_join(spark, d):
    """Genes over the first position of every occurrence."""
    p = placed(spark, d).select("occ", C("contig").alias("seqid"), "s", C("s").alias("e"))
    g = features(spark, d).filter("type = 'gene'").select("id", "seqid", "s", "e").dropna().distinct()
    return overlap_join(p, g, ["seqid"]).groupBy("occ").agg(F.count("*").alias("genes"), F.min("r_id").alias("first_gene"))


@query(f"""WITH {FEAT}, x AS (SELECT DISTINCT id, seqid, strand, s, e FROM f WHERE type = 'exon' AND id IS NOT NULL AND seqid IS NOT NULL AND strand IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL),
c AS (SELECT DISTINCT id, seqid, strand, s, e FROM f WHERE type = 'cds' AND seqid IS NOT NULL AND strand IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL)
SELECT x.id, x.s, x.e, count(c.s) AS n_cds, coalesce(sum(least(x.e, c.e) - greatest(x.s, c.s) + 1), 0)::BIGINT AS bases, min(c.s) AS first_cds FROM x LEFT JOIN c ON x.seqid = c.seqid AND x.strand = c.strand AND x.s <= c.e AND c.s <= x.e GROUP BY x.id, x.seqid, x.strand, x.s, x.e""")
def overlap_left_agg(spark, d):
    f = features(spark, d)
    part = lambda t: f.filter(C("type") == t).select("id", "seqid", "strand", "s", "e").dropna(subset=["seqid", "strand", "s", "e"]).distinct()
    j = overlap_join(part("exon").filter("id IS NOT NULL"), part("cds"), ["seqid", "strand"], how="left")
    out = j.groupBy("id", "seqid", "strand", "s", "e").agg(F.count("r_s").alias("n_cds"), F.coalesce(F.sum(F.least("e", "r_e") - F.greatest("s", "r_s") + 1), F.lit(0)).alias("bases"), F.min("r_s").alias("first_cds"))
    return out.select("id", "s", "e", "n_cds", "bases", "first_cds")


@query(f"""WITH {HOM}, {OCC}, o AS (SELECT occ, max({ROLE.format('role')}) AS bucket, max(family) AS family, max(species) AS species FROM occ WHERE occ IS NOT NULL GROUP BY occ)
SELECT homology, count(DISTINCT h.occ) AS members, count(DISTINCT o.species) AS species, count(DISTINCT o.family) AS families, bool_or(o.occ IS NULL) AS has_unplaced, string_agg(DISTINCT bucket, ';' ORDER BY bucket) AS roles FROM h LEFT JOIN o USING (occ) WHERE homology IS NOT NULL AND h.occ IS NOT NULL GROUP BY homology""")
def element_profiles(spark, d):
    o = occurrences(spark, d).filter("occ IS NOT NULL").groupBy("occ").agg(F.max(scoring.role_bucket("role")).alias("bucket"), F.max("family").alias("family"), F.max("species").alias("species"), F.lit(True).alias("known"))
    h = homology(spark, d).filter("homology IS NOT NULL AND occ IS NOT NULL").join(o, "occ", "left")
    roles = F.array_join(F.array_sort(F.collect_set("bucket")), ";")
    return h.groupBy("homology").agg(F.count_distinct("occ").alias("members"), F.count_distinct("species").alias("species"), F.count_distinct("family").alias("families"), F.bool_or(C("known").isNull()).alias("has_unplaced"), F.when(F.count("bucket") > 0, roles).alias("roles"))


_BEST = f"""{MATCH}, p AS (SELECT q, t, max(total_score) AS score FROM m WHERE status = 'mapped' AND q IS NOT NULL AND t IS NOT NULL AND q <> t AND total_score IS NOT NULL GROUP BY q, t),
both_ AS (SELECT q AS x, t AS y, score FROM p UNION ALL SELECT t, q, score FROM p), ok AS (SELECT x, y FROM (SELECT *, max(score) OVER (PARTITION BY x) AS b FROM both_) WHERE abs(score - b) < 1e-12 GROUP BY x, y),
rb AS (SELECT p.q, p.t, p.score, CASE WHEN a.x IS NOT NULL AND b.x IS NOT NULL THEN 'reciprocal_best' WHEN a.x IS NOT NULL THEN 'query_best_only' ELSE 'not_reciprocal_best' END AS status FROM p LEFT JOIN ok a ON a.x = p.q AND a.y = p.t LEFT JOIN ok b ON b.x = p.t AND b.y = p.q)"""


def _pairs(spark, d):
    return matches(spark, d).filter("status = 'mapped' AND q <> t AND total_score IS NOT NULL")


@query(f"WITH {_BEST} SELECT q, t, round(score, 6) + 0.0 AS score, status FROM rb")
def reciprocal_best_pairs(spark, d):
    return reciprocal_best(_pairs(spark, d), "q", "t", "total_score").select("q", "t", r6(C("total_score")).alias("score"), "status")


@query(f"""WITH {_BEST} SELECT status, count(*) AS pairs, sum(CASE WHEN score >= 0.7 THEN 1 ELSE 0 END)::BIGINT AS high, round(avg(score), 6) + 0.0 AS mean_score FROM rb GROUP BY status""")
def correspondence_summary(spark, d):
    r = reciprocal_best(_pairs(spark, d), "q", "t", "total_score")
    return r.groupBy("status").agg(F.count("*").alias("pairs"), F.sum(F.when(C("total_score") >= 0.7, 1).otherwise(0)).alias("high"), r6(F.avg("total_score")).alias("mean_score"))


_SITE = f"""{OCC}, cell AS (SELECT family, species, CASE WHEN bool_or({STATE.format('presence')} = 'present') THEN 'present' WHEN bool_and({STATE.format('presence')} = 'absent') THEN 'absent' ELSE 'unknown' END AS state, count(DISTINCT copy) AS copies FROM occ WHERE family IS NOT NULL AND species IS NOT NULL GROUP BY family, species)"""


def cells(spark, d):
    """Presence of every family in every species it is seen in: any present, else all absent, else unknown."""
    s = scoring.state("presence")
    return occurrences(spark, d).filter("family IS NOT NULL AND species IS NOT NULL").groupBy("family", "species").agg(F.when(F.bool_or(s == "present"), "present").when(F.bool_and(s == "absent"), "absent").otherwise("unknown").alias("state"), F.count_distinct("copy").alias("copies"))


@query(f"WITH {_SITE} SELECT family, species, state, copies FROM cell")
def priority_vote(spark, d):
    return cells(spark, d)


_GRID = f"""{_SITE}, grid AS (SELECT f.family, s.species, coalesce(c.state, 'unknown') AS state, coalesce(c.copies, 0) AS copies FROM (SELECT DISTINCT family FROM cell) f CROSS JOIN (SELECT DISTINCT species FROM cell) s LEFT JOIN cell c ON c.family = f.family AND c.species = s.species)"""


def site_grid(spark, d):
    c = cells(spark, d)
    return densify(c, c.select("family").distinct(), c.select("species").distinct(), ["family", "species"], {"state": F.lit("unknown"), "copies": F.lit(0)})


@query(f"WITH {_GRID} SELECT * FROM grid")
def site_matrix(spark, d):
    return site_grid(spark, d).select("family", "species", "state", "copies")


@query(f"""WITH {_GRID} SELECT family, sum((state = 'present')::INT)::BIGINT AS present, sum((state = 'absent')::INT)::BIGINT AS absent, sum((state = 'unknown')::INT)::BIGINT AS unknown, round(sum((state <> 'unknown')::INT) / count(*), 6) + 0.0 AS callable,
CASE WHEN sum((state <> 'unknown')::INT) = 0 THEN 'all_missing' WHEN count(DISTINCT CASE WHEN state <> 'unknown' THEN state END) = 1 THEN 'no_observed_contrast' ELSE 'observed_contrast' END AS pattern_class FROM grid GROUP BY family""")
def assess_scope(spark, d):
    known = F.count_if(C("state") != "unknown")
    kinds = F.count_distinct(F.when(C("state") != "unknown", C("state")))
    return site_grid(spark, d).groupBy("family").agg(F.count_if(C("state") == "present").alias("present"), F.count_if(C("state") == "absent").alias("absent"), F.count_if(C("state") == "unknown").alias("unknown"), r6(known / F.count("*")).alias("callable"), F.when(known == 0, "all_missing").when(kinds == 1, "no_observed_contrast").otherwise("observed_contrast").alias("pattern_class"))


@query(f"""WITH {_GRID}, a AS (SELECT family, sum((state <> 'unknown')::INT) AS known, count(*) AS n FROM grid GROUP BY family) SELECT pct, sum((known * 100 >= pct * n)::INT)::BIGINT AS retained, count(*) AS families FROM a CROSS JOIN (VALUES (1), (2), (5), (50), (70), (90)) t(pct) GROUP BY pct""")
def scope_thresholds(spark, d):
    a = site_grid(spark, d).groupBy("family").agg(F.count_if(C("state") != "unknown").alias("known"), N())
    return a.withColumn("pct", F.explode(F.array(*[F.lit(x) for x in (1, 2, 5, 50, 70, 90)]))).groupBy("pct").agg(F.count_if(C("known") * 100 >= C("pct") * C("n")).alias("retained"), F.count("*").alias("families"))


@query(f"""WITH {_GRID}, v AS (SELECT family, string_agg(substring(state, 1, 1), '' ORDER BY species) AS pattern FROM grid GROUP BY family) SELECT pattern, count(*) AS multiplicity, min(family) AS first_family FROM v GROUP BY pattern""")
def pattern_compress(spark, d):
    v = site_grid(spark, d).groupBy("family").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("species", "state"))), lambda x: F.substring(x["state"], 1, 1)), "").alias("pattern"))
    return v.groupBy("pattern").agg(F.count("*").alias("multiplicity"), F.min("family").alias("first_family"))


@query(f"""WITH {_SITE}, over_ AS (SELECT family, species, 'present' AS state, 99 AS copies FROM (SELECT DISTINCT family, species FROM (SELECT {k('family_id')} AS family, {k('species')} AS species FROM documents) WHERE family IS NOT NULL AND species IS NOT NULL))
SELECT family, species, state, copies FROM cell c WHERE NOT EXISTS (SELECT 1 FROM over_ o WHERE o.family = c.family AND o.species = c.species) UNION ALL SELECT * FROM over_""")
def upsert_override(spark, d):
    from branchloom.functions.values import key

    o = table(spark, d, "documents").select(key("family_id").alias("family"), key("species").alias("species")).dropna().distinct()
    return upsert(cells(spark, d), o.select("family", "species", F.lit("present").alias("state"), F.lit(99).cast("bigint").alias("copies")), ["family", "species"])


@query(f"""WITH {ADJ}, {_SITE} SELECT a.family, a.species, count(*) AS violations FROM (SELECT DISTINCT family, species, adjacency FROM a WHERE status = 'present') a JOIN cell c ON a.family = c.family AND a.species = c.species AND c.state <> 'present' GROUP BY ALL""")
def applicability_violations(spark, d):
    a = adjacencies(spark, d).filter("status = 'present'").select("family", "species", "adjacency").distinct()
    return a.join(cells(spark, d).filter("state <> 'present'"), ["family", "species"]).groupBy("family", "species").agg(F.count("*").alias("violations"))


@query(f"""WITH {MATCH}, truth AS (SELECT DISTINCT q, t FROM m WHERE splice = 'conserved' AND q IS NOT NULL AND t IS NOT NULL), call AS (SELECT DISTINCT q, t FROM m WHERE status = 'mapped' AND q IS NOT NULL AND t IS NOT NULL),
j AS (SELECT truth.q IS NOT NULL AS is_true, call.q IS NOT NULL AS is_called FROM truth FULL JOIN call ON truth.q = call.q AND truth.t = call.t)
SELECT sum((is_true AND is_called)::INT)::BIGINT AS tp, sum((is_called AND NOT is_true)::INT)::BIGINT AS fp, sum((is_true AND NOT is_called)::INT)::BIGINT AS fn, round(sum((is_true AND is_called)::INT) / sum(is_called::INT), 6) AS precision_, round(sum((is_true AND is_called)::INT) / sum(is_true::INT), 6) AS recall_ FROM j""")
def truth_vs_calls(spark, d):
    m = matches(spark, d).filter("q IS NOT NULL AND t IS NOT NULL")
    marks = m.groupBy("q", "t").agg(F.bool_or(F.coalesce(C("splice") == "conserved", F.lit(False))).alias("a"), F.bool_or(F.coalesce(C("status") == "mapped", F.lit(False))).alias("b"))
    tp, fp, fn = F.count_if(C("a") & C("b")), F.count_if(C("b") & ~C("a")), F.count_if(C("a") & ~C("b"))
    return marks.agg(tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.round(tp / (tp + fp), 6).alias("precision_"), F.round(tp / (tp + fn), 6).alias("recall_"))


@query(f"""WITH {FEAT} SELECT kw, count(DISTINCT id) AS ids, count(DISTINCT CASE WHEN type = 'exon' THEN id END) AS exons FROM f JOIN (VALUES ('gene'), ('rna'), ('0001'), ('region')) w(kw) ON contains(id, kw) GROUP BY kw""")
def keyword_contains_join(spark, d):
    words = spark.createDataFrame([("gene",), ("rna",), ("0001",), ("region",)], "kw string")
    return features(spark, d).join(F.broadcast(words), F.expr("contains(id, kw)")).groupBy("kw").agg(F.count_distinct("id").alias("ids"), F.count_distinct(F.when(C("type") == "exon", C("id"))).alias("exons"))


@query(f"""WITH {HOM}, {OCC}, o AS (SELECT occ, loaded_at, max(coalesce(role, '')) AS role FROM occ WHERE occ IS NOT NULL AND loaded_at IS NOT NULL GROUP BY occ, loaded_at)
SELECT h.record_no, o.role AS role_at_load FROM h ASOF LEFT JOIN o ON h.occ = o.occ AND h.loaded_at >= o.loaded_at WHERE h.occ IS NOT NULL AND h.loaded_at IS NOT NULL""")
def asof_version(spark, d):
    """The role an occurrence had when a homology row was loaded."""
    o = occurrences(spark, d).filter("occ IS NOT NULL").select("occ", "loaded_at", F.coalesce("role", F.lit("")).alias("role"))
    p = homology(spark, d).filter("occ IS NOT NULL AND loaded_at IS NOT NULL").select("record_no", "occ", "loaded_at")
    return nearest_before(o, p, ["occ"], "loaded_at", "role", "role_at_load").select("record_no", "role_at_load")


# --- aggregations ----------------------------------------------------------


@query(f"WITH {HOM} SELECT homology, count(DISTINCT label) AS labels, count(DISTINCT support) AS supports FROM h WHERE homology IS NOT NULL GROUP BY homology")
def count_distinct_valid(spark, d):
    return homology(spark, d).filter("homology IS NOT NULL").groupBy("homology").agg(F.count_distinct("label").alias("labels"), F.count_distinct("support").alias("supports"))


@query(f"WITH {_SITE} SELECT family, max(copies) AS most, max(copies) > 1 AS multicopy, string_agg(CASE WHEN copies > 1 THEN species END, ';' ORDER BY species) AS multi_species FROM cell GROUP BY family")
def single_copy_families(spark, d):
    multi = F.array_sort(F.collect_set(F.when(C("copies") > 1, C("species"))))
    return cells(spark, d).groupBy("family").agg(F.max("copies").alias("most"), (F.max("copies") > 1).alias("multicopy"), F.when(F.max("copies") > 1, F.array_join(multi, ";")).alias("multi_species"))


_SPANS = f"{PLACED}, sp AS (SELECT family, species, copy, contig, min(s) AS s, max(e) AS e, count(*) AS n FROM placed WHERE family IS NOT NULL AND species IS NOT NULL GROUP BY ALL)"


def _spans(spark, d):
    return placed(spark, d).filter("family IS NOT NULL AND species IS NOT NULL").groupBy("family", "species", "copy", "contig").agg(F.min("s").alias("s"), F.max("e").alias("e"), N())


@query(f"WITH {_SPANS} SELECT * FROM sp")
def copy_spans(spark, d):
    return _spans(spark, d)


_COPIES = f"""{PLACED}, sp AS (SELECT family, species, copy, min(contig) AS contig, min(s) AS s, max(e) AS e FROM placed WHERE family IS NOT NULL AND species IS NOT NULL AND presence = 'present' GROUP BY family, species, copy)"""


def _copies(spark, d):
    """The span of every copy over its present occurrences."""
    p = placed(spark, d).filter("family IS NOT NULL AND species IS NOT NULL AND presence = 'present'")
    return p.groupBy("family", "species", "copy").agg(F.min("contig").alias("contig"), F.min("s").alias("s"), F.max("e").alias("e"))


@query(f"""WITH {_COPIES}, g AS (SELECT *, greatest(0, s - lag(e) OVER (PARTITION BY family, species ORDER BY s, e, copy)) AS gap FROM sp),
c AS (SELECT family, species, count(*) AS copies, count(DISTINCT contig) AS contigs, coalesce(max(gap), 0) AS widest FROM g GROUP BY ALL)
SELECT *, CASE WHEN copies = 1 THEN 'single_copy' WHEN contigs > 1 THEN 'dispersed_multi_copy' WHEN widest <= 250000 THEN 'tandem_multi_copy' ELSE 'same_contig_multi_copy' END AS copy_class FROM c""")
def copy_class(spark, d):
    w = Window.partitionBy("family", "species").orderBy("s", "e", "copy")
    g = _copies(spark, d).withColumn("gap", F.greatest(F.lit(0), C("s") - F.lag("e").over(w)))
    c = g.groupBy("family", "species").agg(F.count("*").alias("copies"), F.count_distinct("contig").alias("contigs"), F.coalesce(F.max("gap"), F.lit(0)).alias("widest"))
    return c.withColumn("copy_class", F.when(C("copies") == 1, "single_copy").when(C("contigs") > 1, "dispersed_multi_copy").when(C("widest") <= 250_000, "tandem_multi_copy").otherwise("same_contig_multi_copy"))


@query(f"""WITH {_COPIES}, p AS (SELECT a.family, a.species, CASE WHEN a.contig <> b.contig THEN 'dispersed_or_retrocopy_candidate' WHEN greatest(0, greatest(a.s, b.s) - least(a.e, b.e)) <= 250000 THEN 'tandem_duplication_candidate' ELSE 'same_contig_duplication_candidate' END AS relationship_class
FROM sp a JOIN sp b ON a.family = b.family AND a.species = b.species AND a.copy < b.copy)
SELECT family, species, relationship_class, CASE relationship_class WHEN 'tandem_duplication_candidate' THEN 0.9 WHEN 'same_contig_duplication_candidate' THEN 0.65 ELSE 0.45 END AS synteny_score, count(*) AS n_pairs FROM p GROUP BY ALL""")
def copy_relationships(spark, d):
    """Pairs of copies per class of relationship. Pairs are counted, not formed: a copy is tandem to those that start by its end and the reach, less those that come before it."""
    sp = _copies(spark, d)
    keys = ["family", "species", "contig"]
    marks = sp.select(*keys, C("s").alias("at"), F.lit(0).alias("kind"), "copy").unionByName(sp.select(*keys, (C("e") + 250_000).alias("at"), F.lit(1).alias("kind"), "copy"))
    starts = F.sum(F.when(C("kind") == 0, 1).otherwise(0)).over(Window.partitionBy(*keys).orderBy("at", "kind", "copy").rowsBetween(Window.unboundedPreceding, 0))
    near = marks.withColumn("n", starts).groupBy(*keys).agg(F.sum(F.when(C("kind") == 1, C("n"))).alias("reached"), F.sum(F.when(C("kind") == 0, C("n"))).alias("before"), F.count_if(C("kind") == 0).alias("c"))
    # summed over copies: starts within reach, less each copy's own rank
    contig = near.select("family", "species", (C("reached") - C("before")).alias("tandem"), (C("c") * (C("c") - 1) / 2).cast("bigint").alias("same"), "c")
    total = contig.groupBy("family", "species").agg(F.sum("tandem").alias("tandem"), F.sum("same").alias("same"), F.sum("c").alias("c"))
    classes = F.explode(F.array(
        F.struct(F.lit("tandem_duplication_candidate").alias("relationship_class"), F.lit(0.9).alias("synteny_score"), C("tandem").alias("n_pairs")),
        F.struct(F.lit("same_contig_duplication_candidate").alias("relationship_class"), F.lit(0.65).alias("synteny_score"), (C("same") - C("tandem")).alias("n_pairs")),
        F.struct(F.lit("dispersed_or_retrocopy_candidate").alias("relationship_class"), F.lit(0.45).alias("synteny_score"), ((C("c") * (C("c") - 1) / 2).cast("bigint") - C("same")).alias("n_pairs")),
    )).alias("x")
    return total.select("family", "species", classes).select("family", "species", "x.*").filter("n_pairs > 0")


_PATH = f"""{PLACED}, path AS (SELECT family, copy, string_agg({ROLE.format('role')}, '>' ORDER BY s, occ) AS path FROM placed WHERE family IS NOT NULL GROUP BY ALL)"""


@query(f"""WITH {_PATH}, v AS (SELECT family, path, count(*) AS n FROM path GROUP BY ALL) SELECT family, path, n, (SELECT sum(n) FROM v x WHERE x.family = v.family)::BIGINT AS of_copies FROM v QUALIFY row_number() OVER (PARTITION BY family ORDER BY n DESC, path) = 1""")
def majority_path(spark, d):
    p = placed(spark, d).filter("family IS NOT NULL").groupBy("family", "copy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "occ", scoring.role_bucket("role").alias("b")))), lambda x: x["b"]), ">").alias("path"))
    v = p.groupBy("family", "path").agg(N())
    best = v.groupBy("family").agg(F.min(F.struct((-C("n")).alias("m"), "path")).alias("b"), F.sum("n").alias("of_copies"))
    return best.select("family", "b.path", (-C("b.m")).alias("n"), "of_copies")


@query(f"""WITH {HOM}, v AS (SELECT homology, label, sum(coalesce({CONF.format('confidence')}, 0.5)) AS vote FROM h WHERE homology IS NOT NULL AND label IS NOT NULL GROUP BY ALL)
SELECT homology, string_agg(label, ';' ORDER BY label) AS labels, round(max(vote), 6) + 0.0 AS best FROM (SELECT *, max(vote) OVER (PARTITION BY homology) AS top FROM v) WHERE round(vote, 6) >= round(0.9 * top, 6) GROUP BY homology""")
def near_best_labels(spark, d):
    h = homology(spark, d).filter("homology IS NOT NULL AND label IS NOT NULL")
    v = h.groupBy("homology", "label").agg(F.sum(F.coalesce(scoring.confidence("confidence"), F.lit(0.5))).alias("vote"))
    v = v.withColumn("top", F.max("vote").over(Window.partitionBy("homology"))).filter(F.round("vote", 6) >= F.round(0.9 * C("top"), 6))
    return v.groupBy("homology").agg(F.array_join(F.array_sort(F.collect_set("label")), ";").alias("labels"), r6(F.max("vote")).alias("best"))


@query(f"""WITH {PLACED}, ev AS (SELECT copy, contig, s AS at_, 1 AS delta FROM placed UNION ALL SELECT copy, contig, e + 1, -1 FROM placed), g AS (SELECT copy, contig, at_, sum(delta) AS delta FROM ev GROUP BY ALL),
x AS (SELECT copy, contig, at_, sum(delta) OVER w AS depth, lead(at_) OVER w AS next FROM g WINDOW w AS (PARTITION BY copy, contig ORDER BY at_)) SELECT copy, contig, max(depth)::BIGINT AS max_depth, sum(CASE WHEN depth > 0 THEN next - at_ ELSE 0 END)::BIGINT AS covered, sum(CASE WHEN depth > 1 THEN next - at_ ELSE 0 END)::BIGINT AS overlapped FROM x GROUP BY ALL""")
def sweep_depth(spark, d):
    p = placed(spark, d)
    ev = p.select("copy", "contig", F.explode(F.array(F.struct(C("s").alias("at_"), F.lit(1).alias("delta")), F.struct((C("e") + 1).alias("at_"), F.lit(-1).alias("delta")))).alias("x")).groupBy("copy", "contig", "x.at_").agg(F.sum("x.delta").alias("delta"))
    w = Window.partitionBy("copy", "contig").orderBy("at_")
    x = ev.withColumns({"depth": F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)), "next": F.lead("at_").over(w)})
    return x.groupBy("copy", "contig").agg(F.max("depth").alias("max_depth"), F.sum(F.when(C("depth") > 0, C("next") - C("at_")).otherwise(0)).alias("covered"), F.sum(F.when(C("depth") > 1, C("next") - C("at_")).otherwise(0)).alias("overlapped"))


_ISLANDS = """r AS (SELECT *, max(e) OVER (PARTITION BY {k} ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM {t}), b AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY {k} ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM r), isl AS (SELECT {k}, island, min(s) AS s, max(e) AS e, count(*) AS n FROM b GROUP BY {k}, island)"""


@query(f"WITH {PLACED}, {_ISLANDS.format(k='copy, contig', t='placed')} SELECT copy, contig, sum(e - s + 1)::BIGINT AS union_length, count(*) AS islands, max(n) AS largest FROM isl GROUP BY ALL")
def interval_union_length(spark, d):
    m = merge_intervals(placed(spark, d), ["copy", "contig"], "s", "e").periods
    return m.groupBy("copy", "contig").agg(F.sum(C("end") - C("start") + 1).alias("union_length"), F.count("*").alias("islands"), F.max("n_intervals").alias("largest"))


_CDS = f"""{FEAT}, cd AS (SELECT DISTINCT parent, s, e FROM f WHERE type = 'cds' AND parent IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL), {_ISLANDS.format(k='parent', t='cd')}"""


@query(f"WITH {_CDS} SELECT parent, sum(e - s + 1)::BIGINT AS cds_length FROM isl GROUP BY parent")
def cds_length(spark, d):
    c = features(spark, d).filter("type = 'cds'").select("parent", "s", "e").dropna().distinct()
    return merge_intervals(c, ["parent"], "s", "e").periods.groupBy("parent").agg(F.sum(C("end") - C("start") + 1).alias("cds_length"))


@query(f"""WITH {_CDS}, len AS (SELECT parent, sum(e - s + 1)::BIGINT AS n FROM isl GROUP BY parent), tx AS (SELECT id, min(parent) AS gene, max(e) - min(s) + 1 AS span FROM f WHERE type IN ('mrna', 'lnc_rna', 'transcript') AND id IS NOT NULL AND parent IS NOT NULL GROUP BY id)
SELECT gene, id AS transcript, coalesce(n, 0) AS cds, span FROM tx LEFT JOIN len ON len.parent = tx.id QUALIFY row_number() OVER (PARTITION BY gene ORDER BY coalesce(n, 0) DESC, span DESC, id DESC) = 1""")
def canonical_pick(spark, d):
    """Per gene the transcript with the longest coding length, then span, then id."""
    f = features(spark, d)
    tx = f.filter("type IN ('mrna', 'lnc_rna', 'transcript') AND id IS NOT NULL AND parent IS NOT NULL").groupBy("id").agg(F.min("parent").alias("gene"), (F.max("e") - F.min("s") + 1).alias("span"))
    j = tx.join(cds_length(spark, d), tx.id == C("parent").alias("p"), "left").groupBy("gene").agg(F.max(F.struct(F.coalesce("cds_length", F.lit(0)).alias("cds"), "span", C("id").alias("transcript"))).alias("b"))
    return j.select("gene", "b.transcript", "b.cds", "b.span")


@query(f"WITH {FEAT} SELECT gene, count(DISTINCT CASE WHEN type = 'exon' THEN id END) AS exons, count(DISTINCT CASE WHEN type = 'cds' THEN id END) AS cds, count(DISTINCT CASE WHEN type IN ('mrna', 'transcript', 'lnc_rna') THEN id END) AS transcripts FROM f WHERE gene IS NOT NULL GROUP BY gene")
def child_counts(spark, d):
    n = lambda *t: F.count_distinct(F.when(C("type").isin(*t), C("id")))
    return features(spark, d).filter("gene IS NOT NULL").groupBy("gene").agg(n("exon").alias("exons"), n("cds").alias("cds"), n("mrna", "transcript", "lnc_rna").alias("transcripts"))


@query(f"""WITH {MATCH}, e AS (SELECT q, t, avg(alignment_score) AS identity, max(total_score) AS best, arg_max(match_id, (coalesce(total_score, -1), match_id)) AS last_match, count(*) AS n FROM m WHERE q IS NOT NULL AND t IS NOT NULL GROUP BY q, t) SELECT q, t, round(identity, 6) + 0.0 AS identity, round(best, 6) + 0.0 AS best, last_match, n FROM e""")
def edge_fold(spark, d):
    m = matches(spark, d).filter("q IS NOT NULL AND t IS NOT NULL")
    return m.groupBy("q", "t").agg(r6(F.avg("alignment_score")).alias("identity"), r6(F.max("total_score")).alias("best"), F.max(F.struct(F.coalesce("total_score", F.lit(-1.0)).alias("s"), "match_id"))["match_id"].alias("last_match"), N())


@query(f"""WITH {_GRID}, s AS (SELECT family, sum((state <> 'unknown')::INT) AS known FROM grid GROUP BY family) SELECT min(known)::BIGINT AS least, max(known)::BIGINT AS most, quantile_cont(known, 0.5) AS median, quantile_cont(known, 0.25) AS q25, quantile_cont(known, 0.9) AS q90 FROM s""")
def analysis_summary(spark, d):
    s = site_grid(spark, d).groupBy("family").agg(F.count_if(C("state") != "unknown").alias("known"))
    q = lambda x: F.percentile("known", F.lit(x))
    return s.agg(F.min("known").alias("least"), F.max("known").alias("most"), q(0.5).alias("median"), q(0.25).alias("q25"), q(0.9).alias("q90"))


@query(f"""WITH {MATCH}, b AS (SELECT least(9, floor(alignment_score * 10))::BIGINT AS bin, alignment_score, (status = 'mapped')::INT AS hit FROM m WHERE alignment_score IS NOT NULL AND status IS NOT NULL) SELECT bin, count(*) AS n, round(avg(alignment_score), 6) + 0.0 AS predicted, round(avg(hit), 6) + 0.0 AS actual, round(avg((alignment_score - hit) * (alignment_score - hit)), 6) + 0.0 AS brier FROM b GROUP BY bin""")
def reliability_bins(spark, d):
    b = matches(spark, d).filter("alignment_score IS NOT NULL AND status IS NOT NULL").select(F.least(F.lit(9), F.floor(C("alignment_score") * 10)).alias("bin"), "alignment_score", (C("status") == "mapped").cast("int").alias("hit"))
    return b.groupBy("bin").agg(N(), r6(F.avg("alignment_score")).alias("predicted"), r6(F.avg("hit")).alias("actual"), r6(F.avg((C("alignment_score") - C("hit")) * (C("alignment_score") - C("hit")))).alias("brier"))


@query(f"""WITH {ADJ} SELECT family, species, count(DISTINCT status) AS states, CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE 'conflict' END AS consensus FROM a WHERE family IS NOT NULL AND species IS NOT NULL AND status IS NOT NULL GROUP BY ALL""")
def consensus_unanimous(spark, d):
    a = adjacencies(spark, d).filter("family IS NOT NULL AND species IS NOT NULL AND status IS NOT NULL")
    return a.groupBy("family", "species").agg(F.count_distinct("status").alias("states"), F.when(F.count_distinct("status") == 1, F.min("status")).otherwise("conflict").alias("consensus"))


@query(f"WITH {OCC} SELECT coalesce(evidence, 'all') AS evidence, coalesce(role, 'all') AS role, count(*) AS n, grouping(evidence)::INT * 2 + grouping(role)::INT AS level FROM occ WHERE evidence IS NOT NULL AND role IS NOT NULL GROUP BY GROUPING SETS ((evidence, role), (evidence), ())")
def evidence_rollup(spark, d):
    o = occurrences(spark, d).filter("evidence IS NOT NULL AND role IS NOT NULL")
    return o.rollup("evidence", "role").agg(N(), F.grouping_id().alias("level")).select(F.coalesce("evidence", F.lit("all")).alias("evidence"), F.coalesce("role", F.lit("all")).alias("role"), "n", C("level").cast("int").alias("level"))


# --- windows and orderings -------------------------------------------------


@query(f"""WITH {PLACED} SELECT * FROM (SELECT copy, occ AS left_occ, lead(occ) OVER w AS right_occ, 'adj' || lpad((row_number() OVER w)::VARCHAR, 4, '0') AS adjacency FROM placed WHERE {STATE.format('presence')} = 'present' WINDOW w AS (PARTITION BY copy ORDER BY contig, s, e, occ)) WHERE right_occ IS NOT NULL""")
def adjacency_lead(spark, d):
    w = Window.partitionBy("copy").orderBy("contig", "s", "e", "occ")
    p = placed(spark, d).filter(scoring.state("presence") == "present")
    return p.select("copy", C("occ").alias("left_occ"), F.lead("occ").over(w).alias("right_occ"), F.concat(F.lit("adj"), F.lpad(F.row_number().over(w).cast("string"), 4, "0")).alias("adjacency")).filter("right_occ IS NOT NULL")


_ORDER = "w AS (PARTITION BY copy ORDER BY CASE WHEN strand = '-' THEN -e ELSE s END, occ)"


@query(f"""WITH {PLACED} SELECT occ, round((row_number() OVER w - 1) / greatest(1, count(*) OVER (PARTITION BY copy) - 1), 6) + 0.0 AS scaled, coalesce(lag({ROLE.format('role')}) OVER w, 'terminal') AS left_role, coalesce(lead({ROLE.format('role')}) OVER w, 'terminal') AS right_role,
CASE WHEN count(*) OVER (PARTITION BY copy) = 1 THEN 'single' WHEN row_number() OVER w = 1 THEN 'first' WHEN row_number() OVER w = count(*) OVER (PARTITION BY copy) THEN 'last' ELSE 'internal' END AS position FROM placed WINDOW {_ORDER}""")
def scaled_index(spark, d):
    w = Window.partitionBy("copy").orderBy(F.when(C("strand") == "-", -C("e")).otherwise(C("s")), "occ")
    n, i = F.count("*").over(Window.partitionBy("copy")), F.row_number().over(w)
    p = placed(spark, d).withColumn("b", scoring.role_bucket("role"))
    pos = F.when(C("n") == 1, "single").when(C("i") == 1, "first").when(C("i") == C("n"), "last").otherwise("internal")
    return p.select("occ", F.lag("b").over(w).alias("l"), F.lead("b").over(w).alias("r"), n.alias("n"), i.alias("i")).select("occ", r6((C("i") - 1) / F.greatest(F.lit(1), C("n") - 1)).alias("scaled"), F.coalesce("l", F.lit("terminal")).alias("left_role"), F.coalesce("r", F.lit("terminal")).alias("right_role"), pos.alias("position"))


@query(f"""WITH {PLACED}, {_ISLANDS.format(k='copy, contig, strand', t="(SELECT * FROM placed WHERE role IS DISTINCT FROM 'intron')")} SELECT * FROM (SELECT copy, contig, strand, e + 1 AS intron_start, lead(s) OVER (PARTITION BY copy, contig, strand ORDER BY s) - 1 AS intron_end FROM isl) WHERE intron_end IS NOT NULL""")
def gaps_between_islands(spark, d):
    p = placed(spark, d).filter("role IS NULL OR role <> 'intron'")
    return merge_intervals(p, ["copy", "contig", "strand"], "s", "e").gaps.select("copy", "contig", "strand", C("gap_start").alias("intron_start"), C("gap_end").alias("intron_end"))


_P = f"{MATCH}, pv AS (SELECT q, splice, round(1.0 / (1 + count(*)), 6) AS p FROM m WHERE q IS NOT NULL AND splice IS NOT NULL GROUP BY q, splice)"


@query(f"""WITH {_P}, r AS (SELECT *, row_number() OVER (PARTITION BY splice ORDER BY p, q) AS rk, count(*) OVER (PARTITION BY splice) AS m FROM pv) SELECT q, splice, p, round(least(1.0, min(p * m / rk) OVER (PARTITION BY splice ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) + 0.0 AS q_value FROM r""")
def bh_by_type(spark, d):
    p = matches(spark, d).filter("q IS NOT NULL AND splice IS NOT NULL").groupBy("q", "splice").agg(F.round(1.0 / (1 + F.count("*")), 6).alias("p"))
    return bh_adjust(p, "p", ["splice"], ["q"]).withColumn("q_value", r6(C("q_value")))


@query(f"""WITH {PLACED}, x AS (SELECT copy, min(s) AS lo, max(e) AS hi FROM placed GROUP BY copy) SELECT occ, round(CASE WHEN strand = '-' THEN 800 - (s - lo) / greatest(hi - lo, 1) * 800 ELSE (s - lo) / greatest(hi - lo, 1) * 800 END, 6) + 0.0 AS x_left FROM placed JOIN x USING (copy)""")
def linear_scale(spark, d):
    p = placed(spark, d)
    x = p.groupBy("copy").agg(F.min("s").alias("lo"), F.max("e").alias("hi"))
    return p.join(x, "copy").select("occ", r6(scoring.scaled_position(C("s"), C("lo"), F.greatest(C("hi"), C("lo") + 1), 800.0, C("strand") == "-")).alias("x_left"))


@query(f"""WITH {MATCH} SELECT status, quantile_cont(total_score, 0.025) AS low, quantile_cont(total_score, 0.5) AS mid, quantile_cont(total_score, 0.975) AS high FROM m WHERE total_score IS NOT NULL AND status IS NOT NULL GROUP BY status""")
def quantiles(spark, d):
    q = lambda x: F.percentile("total_score", F.lit(x))
    return matches(spark, d).filter("total_score IS NOT NULL AND status IS NOT NULL").groupBy("status").agg(q(0.025).alias("low"), q(0.5).alias("mid"), q(0.975).alias("high"))


@query(f"""WITH {MATCH}, c AS (SELECT q, splice, sum(total_score) AS mass FROM m WHERE q IS NOT NULL AND splice IS NOT NULL AND total_score IS NOT NULL GROUP BY ALL), t AS (SELECT *, max(round(mass, 6)) OVER (PARTITION BY q) AS top FROM c)
SELECT q, string_agg(splice, ';' ORDER BY splice) AS modes, count(*) AS ties FROM t WHERE round(mass, 6) = top GROUP BY q""")
def mode_with_ties(spark, d):
    c = matches(spark, d).filter("q IS NOT NULL AND splice IS NOT NULL AND total_score IS NOT NULL").groupBy("q", "splice").agg(F.round(F.sum("total_score"), 6).alias("mass"))
    top = c.groupBy("q").agg(F.max("mass").alias("mass"))
    return c.join(top, ["q", "mass"]).groupBy("q").agg(F.array_join(F.array_sort(F.collect_list("splice")), ";").alias("modes"), F.count("*").alias("ties"))


@query(f"""WITH {OCC} SELECT family, 'g' || lpad((dense_rank() OVER (ORDER BY first_seen, family))::VARCHAR, 6, '0') AS group_no FROM (SELECT family, min(loaded_at) AS first_seen FROM occ WHERE family IS NOT NULL GROUP BY family)""")
def component_order(spark, d):
    """Stable numbering of families by first appearance; one row per family is ranked."""
    f = occurrences(spark, d).filter("family IS NOT NULL").groupBy("family").agg(F.min("loaded_at").alias("first_seen"))
    return f.select("family", F.concat(F.lit("g"), F.lpad(F.dense_rank().over(Window.orderBy("first_seen", "family")).cast("string"), 6, "0")).alias("group_no"))


# --- sets ------------------------------------------------------------------

_IDS = f"""{HOM}, {OCC}, hs AS (SELECT DISTINCT occ FROM h WHERE occ IS NOT NULL), os AS (SELECT DISTINCT occ FROM occ WHERE occ IS NOT NULL)"""


def _ids(spark, d):
    return homology(spark, d).select("occ").filter("occ IS NOT NULL"), occurrences(spark, d).select("occ").filter("occ IS NOT NULL")


@query(f"WITH {_IDS} SELECT 'missing' AS side, occ FROM (SELECT occ FROM hs EXCEPT SELECT occ FROM os) UNION ALL SELECT 'unused', occ FROM (SELECT occ FROM os EXCEPT SELECT occ FROM hs)")
def set_except(spark, d):
    h, o = _ids(spark, d)
    return h.subtract(o).select(F.lit("missing").alias("side"), "occ").unionByName(o.subtract(h).select(F.lit("unused").alias("side"), "occ"))


@query(f"WITH {_IDS} SELECT occ FROM hs INTERSECT SELECT occ FROM os")
def set_intersect(spark, d):
    h, o = _ids(spark, d)
    return h.intersect(o)


@query(f"WITH {MATCH} SELECT DISTINCT a, b FROM (SELECT q AS a, t AS b FROM m UNION ALL SELECT t, q FROM m) WHERE a IS NOT NULL AND b IS NOT NULL")
def union_swap(spark, d):
    m = matches(spark, d).select(C("q").alias("a"), C("t").alias("b")).dropna()
    return m.union(m.select("b", "a")).distinct()


@query(f"WITH {HOM}, {ADJ} SELECT 'homology' AS relation, record_no, support AS kind, NULL AS status FROM h UNION ALL SELECT 'adjacency', record_no, evidence, status FROM a")
def union_by_name(spark, d):
    h = homology(spark, d).select(F.lit("homology").alias("relation"), "record_no", C("support").alias("kind"))
    a = adjacencies(spark, d).select(F.lit("adjacency").alias("relation"), "record_no", C("evidence").alias("kind"), "status")
    return h.unionByName(a, allowMissingColumns=True)


@query(f"WITH {_GRID}, a AS (SELECT family, sum((state <> 'unknown')::INT) AS known FROM grid GROUP BY family) SELECT CASE WHEN known >= 3 THEN 'selected' ELSE 'excluded' END AS part, count(*) AS families, sum(known)::BIGINT AS cells FROM a GROUP BY ALL")
def matrix_split(spark, d):
    a = site_grid(spark, d).groupBy("family").agg(F.count_if(C("state") != "unknown").alias("known"))
    return a.groupBy(F.when(C("known") >= 3, "selected").otherwise("excluded").alias("part")).agg(F.count("*").alias("families"), F.sum("known").alias("cells"))


QUERIES, SQL = query.queries, query.sql
