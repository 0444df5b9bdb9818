"""Evidence calls, element classes, change classes, path contexts, dependencies and small codecs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from branchloom.functions import rules, scoring, sequence, spans
from branchloom.operators.joins import overlap_join
from branchloom.queries.registry import Registry, r6
from branchloom.queries.relational import _COPIES, _copies
from branchloom.queries.scalars import CIGAR, ELEMENT, S, cigars, sequences
from branchloom.functions.text import element_id
from branchloom.queries.views import FEAT, HOM, MATCH, OCC, PLACED, features, homology, matches, occurrences, placed

query = Registry()
C = F.col
_EXONIC = "('cds', 'exon', 'utr', 'noncoding_exon')"


# --- elements --------------------------------------------------------------

_MEMBERS = f"""{HOM}, {PLACED}, mem AS (SELECT DISTINCT h.homology, h.occ, p.occ IS NOT NULL AS known, p.family, p.species, p.copy, p.role, p.presence FROM h LEFT JOIN placed p USING (occ) WHERE h.homology IS NOT NULL AND h.occ IS NOT NULL),
el AS (SELECT homology FROM mem GROUP BY homology HAVING bool_or(role IN {_EXONIC}))"""


def members(spark, d):
    """Occurrences of every homology id with what is known of them, and whether the id is an exon-like element."""
    p = placed(spark, d).select("occ", "family", "species", "copy", "role", "presence", F.lit(True).alias("known"))
    m = homology(spark, d).filter("homology IS NOT NULL AND occ IS NOT NULL").select("homology", "occ").distinct().join(p, "occ", "left").withColumn("known", F.coalesce("known", F.lit(False)))
    el = m.groupBy("homology").agg(F.coalesce(F.bool_or(scoring.role("role").isin(*scoring.EXON_LIKE)), F.lit(False)).alias("is_element"))
    return m.join(el, "homology")


@query(f"""WITH {_MEMBERS} SELECT homology, occ, CASE WHEN homology IN (SELECT homology FROM el) THEN {ELEMENT.format('homology')} END AS element_id,
CASE WHEN homology NOT IN (SELECT homology FROM el) THEN 'context' WHEN presence = 'absent' THEN 'absent' WHEN role IN {_EXONIC} THEN 'exon_like' ELSE 'candidate_source' END AS element_class FROM mem""")
def element_class(spark, d):
    cls = F.when(~C("is_element"), "context").when(C("presence") == "absent", "absent").when(scoring.role("role").isin(*scoring.EXON_LIKE), "exon_like").otherwise("candidate_source")
    return members(spark, d).select("homology", "occ", F.when(C("is_element"), element_id(C("homology"))).alias("element_id"), cls.alias("element_class"))


@query(f"""WITH {_MEMBERS}, r AS (SELECT homology, bool_or(presence = 'present' AND role = 'cds') AS c, bool_or(presence = 'present' AND role IN ('utr', 'noncoding_exon', 'exon')) AS x, bool_or(presence = 'present' AND role IN ('intron', 'intergenic')) AS n, bool_or(presence = 'present') AS p FROM mem GROUP BY homology)
SELECT homology, CASE WHEN NOT coalesce(p, false) THEN 'absent' WHEN c THEN 'CDS' WHEN x THEN 'exon_or_UTR' WHEN n THEN 'non_exonic_source' ELSE 'unknown' END AS element_role FROM r""")
def element_role(spark, d):
    here = C("presence") == "present"
    some = lambda cond: F.coalesce(F.bool_or(here & cond), F.lit(False))
    r = members(spark, d).groupBy("homology").agg(some(C("role") == "cds").alias("c"), some(C("role").isin("utr", "noncoding_exon", "exon")).alias("x"), some(C("role").isin(*scoring.NONCODING)).alias("n"), some(F.lit(True)).alias("p"))
    return r.select("homology", F.when(~C("p"), "absent").when(C("c"), "CDS").when(C("x"), "exon_or_UTR").when(C("n"), "non_exonic_source").otherwise("unknown").alias("element_role"))


@query(f"""WITH {MATCH}, {PLACED}, j AS (SELECT coalesce(a.role, '') AS lr, coalesce(b.role, '') AS rr FROM m JOIN placed a ON a.occ = m.q JOIN placed b ON b.occ = m.t)
SELECT lr AS left_role, rr AS right_role, lr = rr OR (lr IN ('cds', 'exon', 'utr', 'noncoding_exon', 'intron', 'intergenic') AND rr IN ('cds', 'exon', 'utr', 'noncoding_exon', 'intron', 'intergenic')) AS compatible, count(*) AS n FROM j GROUP BY ALL""")
def role_compatibility(spark, d):
    p = placed(spark, d).select("occ", F.coalesce("role", F.lit("")).alias("role"))
    j = matches(spark, d).select("q", "t").join(p.select(C("occ").alias("q"), C("role").alias("left_role")), "q").join(p.select(C("occ").alias("t"), C("role").alias("right_role")), "t")
    return j.groupBy("left_role", "right_role", scoring.roles_compatible(C("left_role"), C("right_role")).alias("compatible")).agg(F.count("*").alias("n"))


# --- path context and evidence without alignment ----------------------------

_ORDER = f"""{PLACED}, ord AS (SELECT occ, e - s + 1 AS n, coalesce(role, 'unknown') AS role, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY copy, tx, strand) AS total, coalesce(lag(coalesce(role, 'unknown')) OVER w, 'terminal') AS left_role, coalesce(lead(coalesce(role, 'unknown')) OVER w, 'terminal') AS right_role
  FROM placed WINDOW w AS (PARTITION BY copy, tx, strand ORDER BY CASE WHEN strand = '-' THEN -e ELSE s END, CASE WHEN strand = '-' THEN -s ELSE e END, occ)),
ctx AS (SELECT occ, n, role, i / greatest(1, total - 1) AS scaled, left_role, right_role, total FROM ord)"""


def contexts(spark, d):
    """Place of every occurrence along its transcript's path in the direction of transcription, with its neighbours' roles."""
    role = F.coalesce("role", F.lit("unknown"))
    minus = C("strand") == "-"
    w = Window.partitionBy("copy", "tx", "strand").orderBy(F.when(minus, -C("e")).otherwise(C("s")), F.when(minus, -C("s")).otherwise(C("e")), "occ")
    whole = Window.partitionBy("copy", "tx", "strand")
    near = lambda f: F.coalesce(f(role).over(w), F.lit("terminal"))
    o = placed(spark, d).select("occ", (C("e") - C("s") + 1).alias("n"), role.alias("role"), (F.row_number().over(w) - 1).alias("i"), F.count("*").over(whole).alias("total"), near(F.lag).alias("left_role"), near(F.lead).alias("right_role"))
    return o.select("occ", "n", "role", (C("i") / F.greatest(F.lit(1), C("total") - 1)).alias("scaled"), "left_role", "right_role", "total")


@query(f"WITH {_ORDER} SELECT occ, round(scaled, 6) + 0.0 AS scaled_index, left_role, right_role, total AS copy_size FROM ctx")
def order_context(spark, d):
    return contexts(spark, d).select("occ", r6(C("scaled")).alias("scaled_index"), "left_role", "right_role", C("total").alias("copy_size"))


_CONTEXT = "CASE WHEN {0} = 'unknown' OR {1} = 'unknown' THEN 0.5 WHEN {0} = {1} THEN 1.0 WHEN {0} = 'terminal' OR {1} = 'terminal' THEN 0.5 ELSE 0.25 END"


@query(f"""WITH {MATCH}, {_ORDER}, j AS (SELECT match_id, 1 - abs(a.scaled - b.scaled) AS ord_, {_CONTEXT.format('a.left_role', 'b.left_role')} AS lc, {_CONTEXT.format('a.right_role', 'b.right_role')} AS rc,
CASE WHEN a.role = b.role THEN 1.0 WHEN a.role IN {_EXONIC} AND b.role IN {_EXONIC} THEN 0.75 WHEN (a.role IN {_EXONIC} AND b.role IN ('intron', 'intergenic')) OR (b.role IN {_EXONIC} AND a.role IN ('intron', 'intergenic')) THEN 0.45 ELSE 0.25 END AS bd, least(a.n, b.n) / greatest(a.n, b.n) AS ratio FROM m JOIN ctx a ON a.occ = m.q JOIN ctx b ON b.occ = m.t)
SELECT match_id, round(lc, 6) AS left_context, round(rc, 6) AS right_context, bd AS boundary, round(ord_, 6) + 0.0 AS order_score, round(ratio, 6) + 0.0 AS size_ratio, round(0.5 * lc + 0.5 * rc, 6) AS structural_context, round(0.1 * lc + 0.1 * rc + 0.1 * bd + 0.08 * 0.6 + 0.06 * ord_ + 0.04 + 0.04, 6) + 0.0 AS total FROM j""")
def cheap_match_evidence(spark, d):
    """Evidence of a pair from its places and roles only: nothing is aligned, phases are unknown, strand and splice agree."""
    c = contexts(spark, d)
    side = lambda x: c.select(*[C(n).alias(f"{x}_{n}") for n in c.columns])
    j = matches(spark, d).select("match_id", "q", "t").join(side("a"), C("q") == C("a_occ")).join(side("b"), C("t") == C("b_occ"))
    left, right = scoring.context_score(C("a_left_role"), C("b_left_role")), scoring.context_score(C("a_right_role"), C("b_right_role"))
    bound, order = scoring.role_boundary_score(C("a_role"), C("b_role")), 1 - F.abs(C("a_scaled") - C("b_scaled"))
    phase = scoring.phase_score(F.lit(None), F.lit(None))
    total = 0.1 * left + 0.1 * right + 0.1 * bound + 0.08 * phase + 0.06 * order + 0.04 + 0.04
    return j.select("match_id", left.alias("left_context"), right.alias("right_context"), bound.alias("boundary"), r6(order).alias("order_score"), r6(F.least("a_n", "b_n") / F.greatest("a_n", "b_n")).alias("size_ratio"), r6(0.5 * left + 0.5 * right).alias("structural_context"), r6(total).alias("total"))


# --- completion calls --------------------------------------------------------

_EVID = f"""{MATCH}, {PLACED}, ev AS (SELECT match_id, CASE WHEN status = 'unmapped' THEN NULL ELSE least(coalesce(alignment_score, 0), coalesce(size_ratio, 1)) END AS support,
CASE WHEN status = 'unmapped' THEN 'supports_absence' WHEN splice = 'novel_splice' THEN 'supports_hidden_segment' WHEN splice IN ('weak_donor', 'weak_acceptor') THEN 'conflicts_annotation' WHEN splice = 'conserved' THEN 'supports_annotation' ELSE 'homologous_sequence_candidate' END AS es,
CASE WHEN left_context_score >= 0.5 AND right_context_score >= 0.5 THEN 'ordered_double_flank_bounded_interval' ELSE 'unknown' END AS an,
CASE WHEN status = 'mapped' THEN 'protein_cds_projection' WHEN status = 'mapped_provisional' THEN 'shifted_splice_site' ELSE '' END AS event, CASE WHEN status LIKE 'candidate%' THEN 'frameshift_or_stop_risk' ELSE '' END AS frame, coalesce(b.role, 'unknown') AS ir, coalesce(a.role, 'unknown') AS pr
FROM m LEFT JOIN placed a ON a.occ = m.q LEFT JOIN placed b ON b.occ = m.t),
cc AS (SELECT *, CASE WHEN an = 'unknown' THEN 'ambiguous_evidence' WHEN es = 'supports_hidden_segment' AND event = 'protein_cds_projection' AND pr IN {_EXONIC} AND support >= 0.55 THEN 'predicted_exon_candidate'
WHEN es = 'supports_hidden_segment' AND ir IN {_EXONIC} AND support >= 0.55 THEN CASE WHEN event = 'shifted_splice_site' THEN 'shifted_splice_site_candidate' WHEN frame = 'frameshift_or_stop_risk' THEN 'hidden_segment_with_frame_disruption' ELSE 'hidden_segment_candidate' END
WHEN es = 'conflicts_annotation' AND ir IN {_EXONIC} AND support >= 0.55 THEN 'annotation_conflict_candidate' WHEN es = 'supports_annotation' THEN 'supports_annotation' WHEN es = 'supports_absence' THEN 'supports_true_absence' WHEN es = 'homologous_sequence_candidate' THEN es ELSE 'ambiguous_evidence' END AS call FROM ev)"""


def _calls(spark, d):
    p = placed(spark, d).select("occ", F.coalesce("role", F.lit("unknown")).alias("role"))
    m = matches(spark, d).join(p.select(C("occ").alias("q"), C("role").alias("pr")), "q", "left").join(p.select(C("occ").alias("t"), C("role").alias("ir")), "t", "left")
    unmapped = F.coalesce(C("status") == "unmapped", F.lit(False))
    support = F.when(~unmapped, F.least(F.coalesce("alignment_score", F.lit(0.0)), F.coalesce("size_ratio", F.lit(1.0))))
    c = {
        "evidence_status": F.when(unmapped, "supports_absence").when(C("splice") == "novel_splice", "supports_hidden_segment").when(C("splice").isin("weak_donor", "weak_acceptor"), "conflicts_annotation").when(C("splice") == "conserved", "supports_annotation").otherwise("homologous_sequence_candidate"),
        "anchor_status": F.when((C("left_context_score") >= 0.5) & (C("right_context_score") >= 0.5), rules.BOUNDED[0]).otherwise("unknown"),
        "event": F.when(C("status") == "mapped", "protein_cds_projection").when(C("status") == "mapped_provisional", "shifted_splice_site").otherwise(""),
        "frame": F.when(C("status").startswith("candidate"), "frameshift_or_stop_risk").otherwise(""),
        "inferred_role": F.coalesce("ir", F.lit("unknown")), "predicted_role": F.coalesce("pr", F.lit("unknown")), "annotation_status": F.lit("unknown"),
    }
    return m.withColumn("support", support).select("match_id", "support", c["event"].alias("event"), rules.completion_call(c, C("support")).alias("call"))


@query(f"WITH {_EVID} SELECT match_id, round(support, 6) + 0.0 AS support, call FROM cc")
def completion_call(spark, d):
    """Calls on match rows read as evidence: statuses from match and splice status, anchors from both contexts."""
    return _calls(spark, d).select("match_id", r6(C("support")).alias("support"), "call")


@query(f"""WITH {_EVID} SELECT call, CASE call WHEN 'hidden_segment_candidate' THEN 'sequence_supported_annotation_gap' WHEN 'shifted_splice_site_candidate' THEN 'splice_boundary_shift' WHEN 'hidden_segment_with_frame_disruption' THEN 'pseudogenization_or_frame_disruption' ELSE 'annotation_or_alignment_evidence' END AS event_class, count(*) AS n FROM cc GROUP BY call""")
def completion_summary(spark, d):
    return _calls(spark, d).groupBy("call", rules.completion_event_class(C("call"), C("event")).alias("event_class")).agg(F.count("*").alias("n"))


# --- changes -----------------------------------------------------------------

_EVENT_LAYERS = ["splice_junction", "exon_presence", "exon_role", "other"]


@query(f"""WITH l(layer) AS (VALUES {", ".join(f"('{x}')" for x in _EVENT_LAYERS)}), b(p) AS (VALUES (0), (1)), w(within_exon) AS (VALUES (true), (false))
SELECT layer, x.p AS parent_state, y.p AS child_state, within_exon, CASE WHEN x.p = y.p THEN 'no_change' ELSE CASE layer WHEN 'splice_junction' THEN 'intron' WHEN 'exon_presence' THEN 'sequence' WHEN 'exon_role' THEN 'exon_role' ELSE 'state' END || CASE WHEN x.p = 0 THEN '_gain' ELSE '_loss' END END AS event_type,
CASE WHEN layer = 'splice_junction' AND within_exon AND x.p <> y.p THEN CASE WHEN x.p = 0 THEN 'exon_split' ELSE 'exon_fusion' END ELSE 'NA' END AS relation FROM l, b x, b y, w""")
def event_types(spark, d):
    g = spark.createDataFrame([(x, a, b, w) for x in _EVENT_LAYERS for a in (0, 1) for b in (0, 1) for w in (True, False)], "layer string, parent_state int, child_state int, within_exon boolean")
    return g.select("layer", "parent_state", "child_state", "within_exon", rules.event_type(C("layer"), C("parent_state"), C("child_state")).alias("event_type"), rules.structural_relation(C("layer"), C("within_exon"), C("parent_state"), C("child_state")).alias("relation"))


@query(f"""WITH {_COPIES}, n AS (SELECT family, species, count(*) AS copies, count(DISTINCT contig) AS contigs FROM sp GROUP BY ALL), s AS (SELECT family, species, CASE WHEN copies = 1 THEN 'single_copy' WHEN contigs > 1 THEN 'dispersed_multi_copy' ELSE 'tandem_multi_copy' END AS state FROM n),
p AS (SELECT *, lead(state) OVER (PARTITION BY family ORDER BY species) AS next_state FROM s)
SELECT state AS source_state, next_state AS target_state, c AS event_class, CASE WHEN c LIKE 'copy_%' THEN 'copy_context' ELSE 'core_structural_event' END AS scope, count(*) AS n FROM (SELECT *, CASE WHEN next_state = 'tandem_multi_copy' THEN 'copy_duplication_or_expansion' WHEN next_state = 'dispersed_multi_copy' THEN 'copy_duplication_or_relocation' WHEN state = 'tandem_multi_copy' THEN 'copy_loss_or_collapse' ELSE 'copy_multiplicity_shift' END AS c FROM p WHERE next_state IS NOT NULL) GROUP BY ALL""")
def branch_event_classes(spark, d):
    """Changes of copy number between species next to each other by name, with class and scope."""
    n = _copies(spark, d).groupBy("family", "species").agg(F.count("*").alias("copies"), F.count_distinct("contig").alias("contigs"))
    s = n.withColumn("state", F.when(C("copies") == 1, "single_copy").when(C("contigs") > 1, "dispersed_multi_copy").otherwise("tandem_multi_copy"))
    p = s.withColumn("next_state", F.lead("state").over(Window.partitionBy("family").orderBy("species"))).filter("next_state IS NOT NULL")
    c = rules.branch_event_class(F.lit("copy_multiplicity"), C("state"), C("next_state"))
    return p.groupBy(C("state").alias("source_state"), C("next_state").alias("target_state"), c.alias("event_class"), rules.call_scope(c).alias("scope")).agg(F.count("*").alias("n"))


# --- copies, adjacencies, dependencies ---------------------------------------


@query(f"""WITH {_COPIES}, g AS (SELECT *, greatest(0, s - lag(e) OVER (PARTITION BY family, species ORDER BY s, e, copy)) AS gap FROM sp),
c AS (SELECT family, species, CASE WHEN count(*) = 1 THEN 'single_copy' WHEN count(DISTINCT contig) > 1 THEN 'dispersed_multi_copy' WHEN coalesce(max(gap), 0) <= 250000 THEN 'tandem_multi_copy' ELSE 'same_contig_multi_copy' END AS copy_class, count(*) AS n FROM g GROUP BY ALL),
r AS (SELECT family, species, copy, bool_or(role = 'intron') AS has_intron, bool_or(role IN ('cds', 'exon', 'utr')) AS has_exon FROM placed WHERE presence = 'present' GROUP BY ALL)
SELECT sp.family, sp.species, sp.copy, copy_class, CASE WHEN NOT coalesce(has_intron, false) AND has_exon AND n > 1 THEN 'processed_or_intronless_copy_candidate' ELSE copy_class END AS copy_subclass, contig || ':' || s || '-' || e AS copy_span FROM sp JOIN c USING (family, species) JOIN r USING (family, species, copy)""")
def copy_context(spark, d):
    from branchloom.queries.relational import copy_class

    classes = copy_class(spark, d).select("family", "species", "copy_class", "copies")
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    r = placed(spark, d).filter("presence = 'present'").groupBy("family", "species", "copy").agg(some(C("role") == "intron").alias("has_intron"), some(C("role").isin("cds", "exon", "utr")).alias("has_exon"))
    j = _copies(spark, d).join(classes, ["family", "species"]).join(r, ["family", "species", "copy"])
    sub = F.when(~C("has_intron") & C("has_exon") & (C("copies") > 1), "processed_or_intronless_copy_candidate").otherwise(C("copy_class"))
    return j.select("family", "species", "copy", "copy_class", sub.alias("copy_subclass"), F.concat("contig", F.lit(":"), "s", F.lit("-"), "e").alias("copy_span"))


@query(f"""WITH {PLACED}, a AS (SELECT family, species, copy, occ AS left_occ, lead(occ) OVER w AS right_occ, row_number() OVER w AS i FROM placed WHERE presence = 'present' AND family IS NOT NULL AND species IS NOT NULL WINDOW w AS (PARTITION BY family, species, copy ORDER BY s, e, occ))
SELECT species || '_' || copy || '_adj_' || lpad(i::VARCHAR, greatest(3, length(i::VARCHAR))::INT, '0') AS adjacency_id, family, left_occ, right_occ FROM a WHERE right_occ IS NOT NULL""")
def adjacency_ids(spark, d):
    """Consecutive present occurrences of every copy."""
    w = Window.partitionBy("family", "species", "copy").orderBy("s", "e", "occ")
    a = placed(spark, d).filter("presence = 'present' AND family IS NOT NULL AND species IS NOT NULL").select("family", "species", "copy", C("occ").alias("left_occ"), F.lead("occ").over(w).alias("right_occ"), F.row_number().over(w).alias("i"))
    return a.filter("right_occ IS NOT NULL").select(F.format_string("%s_%s_adj_%03d", "species", "copy", "i").alias("adjacency_id"), "family", "left_occ", "right_occ")


@query(f"WITH {_COPIES} SELECT family, bool_or(n > 1) AS multicopy, sum(n)::BIGINT AS copies, count(*) AS species FROM (SELECT family, species, count(*) AS n FROM sp GROUP BY ALL) GROUP BY family")
def multicopy_families(spark, d):
    n = _copies(spark, d).groupBy("family", "species").agg(F.count("*").alias("n"))
    return n.groupBy("family").agg(F.bool_or(C("n") > 1).alias("multicopy"), F.sum("n").alias("copies"), F.count("*").alias("species"))


@query(f"""WITH {PLACED}, x AS (SELECT a.occ AS l, b.occ AS r, 'overlap:' || a.copy || '/' || greatest(a.s, b.s) || '/' || least(a.e, b.e) AS g FROM placed a JOIN placed b ON a.copy = b.copy AND a.contig = b.contig AND a.strand = b.strand AND a.occ < b.occ AND a.s <= b.e AND b.s <= a.e)
SELECT occ, count(DISTINCT g) AS n_groups, min(g) AS first_group FROM (SELECT l AS occ, g FROM x UNION ALL SELECT r, g FROM x) GROUP BY occ""")
def interval_dependency(spark, d):
    """Occurrences of a copy that share positions, and the groups this makes."""
    p = placed(spark, d).select("occ", "copy", "contig", "strand", "s", "e")
    x = overlap_join(p, p, ["copy", "contig", "strand"]).filter("occ < r_occ").select("occ", "r_occ", F.concat_ws("/", F.concat(F.lit("overlap:"), "copy"), F.greatest("s", "r_s").cast("string"), F.least("e", "r_e").cast("string")).alias("g"))
    both = x.select("occ", "g").unionByName(x.select(C("r_occ").alias("occ"), "g"))
    return both.groupBy("occ").agg(F.count_distinct("g").alias("n_groups"), F.min("g").alias("first_group"))


_BLOCK = """CASE WHEN x.copy IS NULL THEN 'uncovered' WHEN b.contig <> x.contig THEN 'uncovered' WHEN b.strand <> x.strand THEN 'conflicting' WHEN b.inside THEN 'exonic' WHEN b.touching THEN 'conflicting' WHEN x.s <= b.s AND b.e <= x.e THEN 'not_exonic' ELSE 'uncovered' END"""


@query(f"""WITH {PLACED}, ex AS (SELECT DISTINCT copy, contig, strand, s, e FROM placed WHERE role IN {_EXONIC}), x AS (SELECT copy, min(contig) AS contig, min(strand) AS strand, min(s) AS s, max(e) AS e FROM ex GROUP BY copy HAVING count(DISTINCT contig || strand) = 1),
b AS (SELECT i.occ, i.copy, i.contig, i.strand, i.s, i.e, coalesce(bool_or(ex.s <= i.s AND i.e <= ex.e), false) AS inside, count(ex.s) > 0 AS touching FROM placed i LEFT JOIN ex ON ex.copy = i.copy AND ex.contig = i.contig AND ex.strand = i.strand AND ex.s <= i.e AND i.s <= ex.e WHERE i.role = 'intron' GROUP BY ALL)
SELECT b.occ, {_BLOCK} AS call FROM b LEFT JOIN x ON x.copy = b.copy""")
def block_in_path(spark, d):
    """Untranscribed intervals against the exonic path of their copy: inside an exon, across its border, between exons or outside."""
    p = placed(spark, d)
    ex = p.filter(C("role").isin(*scoring.EXON_LIKE)).select("copy", "contig", "strand", "s", "e").distinct()
    x = ex.groupBy("copy").agg(F.min("contig").alias("x_contig"), F.min("strand").alias("x_strand"), F.min("s").alias("x_s"), F.max("e").alias("x_e"), F.count_distinct("contig", "strand").alias("k")).filter("k = 1").drop("k")
    i = p.filter("role = 'intron'").select("occ", "copy", "contig", "strand", "s", "e")
    b = overlap_join(i, ex, ["copy", "contig", "strand"], how="left").groupBy("occ", "copy", "contig", "strand", "s", "e").agg(F.coalesce(F.bool_or((C("r_s") <= C("s")) & (C("e") <= C("r_e"))), F.lit(False)).alias("inside"), (F.count("r_s") > 0).alias("touching"))
    call = F.when(C("x_s").isNull() | (C("contig") != C("x_contig")), "uncovered").when(C("strand") != C("x_strand"), "conflicting").when(C("inside"), "exonic").when(C("touching"), "conflicting").when((C("x_s") <= C("s")) & (C("e") <= C("x_e")), "not_exonic").otherwise("uncovered")
    return b.join(x, "copy", "left").select("occ", call.alias("call"))


@query(f"""WITH {PLACED}, o AS (SELECT copy, contig, s, e, max(e) OVER (PARTITION BY copy, contig ORDER BY s, e, occ ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, occ FROM placed),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY copy, contig ORDER BY s, e, occ ROWS UNBOUNDED PRECEDING) AS no FROM o)
SELECT copy, contig, min(s) AS comp_start, max(e) AS comp_end, count(*) AS members FROM g GROUP BY copy, contig, no""")
def interval_components(spark, d):
    """Connected components of intervals that share positions; touching ones stay apart. A component is a period with its touching parts cut."""
    w = Window.partitionBy("copy", "contig").orderBy("s", "e", "occ")
    o = placed(spark, d).withColumn("reach", F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    g = o.withColumn("no", F.sum(F.when(C("reach").isNull() | (C("s") > C("reach")), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("copy", "contig", "no").agg(F.min("s").alias("comp_start"), F.max("e").alias("comp_end"), F.count("*").alias("members")).drop("no")


@query(f"""WITH {FEAT}, x AS (SELECT DISTINCT id, seqid, strand, s, e FROM f WHERE type = 'exon' AND id IS NOT NULL AND seqid IS NOT NULL AND strand IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL), c AS (SELECT DISTINCT seqid, strand, s, e FROM f WHERE type = 'cds' AND s IS NOT NULL AND e IS NOT NULL)
SELECT x.id, x.s, x.e, CASE WHEN count(c.s) > 0 THEN 'CDS' ELSE 'noncoding_exon' END AS coding_role FROM x LEFT JOIN c ON c.seqid = x.seqid AND c.strand = x.strand AND c.s <= x.e AND x.s <= c.e GROUP BY x.id, x.seqid, x.strand, x.s, x.e""")
def coding_role(spark, d):
    f = features(spark, d).filter("s IS NOT NULL AND e IS NOT NULL AND seqid IS NOT NULL AND strand IS NOT NULL")
    x = f.filter("type = 'exon' AND id IS NOT NULL").select("id", "seqid", "strand", "s", "e").distinct()
    j = overlap_join(x, f.filter("type = 'cds'").select("seqid", "strand", "s", "e").distinct(), ["seqid", "strand"], how="left")
    return j.groupBy("id", "seqid", "strand", "s", "e").agg(F.when(F.count("r_s") > 0, "CDS").otherwise("noncoding_exon").alias("coding_role")).select("id", "s", "e", "coding_role")


# --- codecs --------------------------------------------------------------------


@query(f"WITH {HOM}, r AS (SELECT record_no, coalesce(cs::VARCHAR, '.') AS a, coalesce(ce::VARCHAR, '.') AS b, cs, ce FROM h) SELECT record_no, a || ',' || b AS range_text, CASE WHEN a = b THEN false WHEN cs IS NULL THEN true WHEN ce IS NULL THEN false ELSE cs < ce END AS start_partial, CASE WHEN a = b THEN false WHEN cs IS NULL THEN false WHEN ce IS NULL THEN true ELSE cs < ce END AS end_partial FROM r")
def range_partial(spark, d):
    text = F.concat_ws(",", F.coalesce(C("cs").cast("string"), F.lit(".")), F.coalesce(C("ce").cast("string"), F.lit(".")))
    h = homology(spark, d).select("record_no", text.alias("range_text"))
    return h.select("record_no", "range_text", rules.range_is_partial(C("range_text"), F.lit("start")).alias("start_partial"), rules.range_is_partial(C("range_text"), F.lit("end")).alias("end_partial"))


@query(f"WITH {HOM} SELECT homology, string_agg(DISTINCT label, ';' ORDER BY label) AS labels FROM h WHERE homology IS NOT NULL AND label IS NOT NULL AND label NOT IN ('unknown', 'unknown_source') GROUP BY homology")
def label_split(spark, d):
    """Source labels of a homology id, joined to one text and split again."""
    h = homology(spark, d).filter("homology IS NOT NULL AND label IS NOT NULL").groupBy("homology").agg(F.array_join(F.collect_list("label"), "|").alias("text"))
    return h.select("homology", F.array_join(rules.split_labels(C("text")), ";").alias("labels")).filter("labels <> ''")


@query(f"""WITH {FEAT}, t AS (SELECT DISTINCT id, trim(replace(p, '"', '')) AS token FROM (SELECT id, unnest(list_concat([id], string_split(replace(coalesce(parents, ''), ',', ';'), ';'))) AS p FROM f WHERE id IS NOT NULL)), k AS (SELECT DISTINCT id, unnest([token, split_part(token, ':', -1)]) AS token FROM t WHERE token NOT IN ('', '.', 'na'))
SELECT id, count(*) AS n_tokens, min(token) AS first_token FROM k WHERE token <> '' GROUP BY id""")
def feature_tokens(spark, d):
    """Tokens an annotation feature can be looked up by."""
    f = features(spark, d).filter("id IS NOT NULL").select("id", F.explode(rules.feature_tokens(C("id"), C("parents"))).alias("token")).distinct()
    return f.groupBy("id").agg(F.count("*").alias("n_tokens"), F.min("token").alias("first_token"))


@query(f"WITH {HOM}, b AS (SELECT record_no, cs, ce FROM h WHERE cs IS NOT NULL AND ce IS NOT NULL AND cs > 0 AND ce > 0) SELECT record_no, cs || '-' || ce || ':' || cs + 10 || '-' || ce + 10 || ';' || cs || '-' || cs || ':' || ce || '-' || ce AS blocks, 2 AS n, (ce - cs + 1 + 1)::BIGINT AS query_bases FROM b")
def block_codec(spark, d):
    h = homology(spark, d).filter("cs IS NOT NULL AND ce IS NOT NULL AND cs > 0 AND ce > 0")
    text = F.format_string("%d-%d:%d-%d;;bad;%d-%d:%d-%d", "cs", "ce", C("cs") + 10, C("ce") + 10, "cs", "cs", "ce", "ce")
    b = h.select("record_no", rules.parse_block_pairs(text).alias("b"))
    return b.select("record_no", rules.format_block_pairs(C("b")).alias("blocks"), F.size("b").alias("n"), F.aggregate("b", F.lit(0).cast("bigint"), lambda s, x: s + x["q2"] - x["q1"] + 1).alias("query_bases"))


@query(f"""WITH {PLACED}, n AS (SELECT *, lead(occ) OVER w AS o2, lead(contig) OVER w AS c2, lead(strand) OVER w AS st2, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM placed WINDOW w AS (PARTITION BY copy ORDER BY s, e, occ))
SELECT occ, CASE WHEN contig = c2 AND s <= e2 AND s2 <= e AND strand = st2 THEN 'true' ELSE 'false' END AS same_strand, CASE WHEN contig = c2 AND s <= e2 AND s2 <= e THEN 'unknown' ELSE 'false' END AS no_strand FROM n WHERE o2 IS NOT NULL""")
def blocks_overlap(spark, d):
    """Whether neighbours of a copy overlap, with their strands and with one strand missing."""
    w = Window.partitionBy("copy").orderBy("s", "e", "occ")
    text = F.format_string("%s:%d-%d:%s;odd", "contig", "s", "e", "strand")
    n = placed(spark, d).withColumn("mine", text).select("occ", "mine", F.lead("mine").over(w).alias("other")).filter("other IS NOT NULL")
    told = lambda a, b: F.coalesce(rules.blocks_overlap_status(rules.genomic_blocks(a), rules.genomic_blocks(b)).cast("string"), F.lit("unknown"))
    return n.select("occ", told(C("mine"), C("other")).alias("same_strand"), told(F.regexp_replace("mine", ":[+-];", ":NA;"), C("other")).alias("no_strand"))


@query(f"""WITH {PLACED}, loc AS (SELECT copy, contig, strand, min(s) AS ls, max(e) AS le FROM placed GROUP BY ALL) SELECT occ, s AS genome_start, e AS genome_end, least(e, le) - greatest(s, ls) + 1 AS shared FROM placed JOIN loc USING (copy, contig, strand)""")
def local_to_genome(spark, d):
    """Intervals taken to the coordinates of their locus and back, and what they share with it."""
    p = placed(spark, d)
    loc = p.groupBy("copy", "contig", "strand").agg(F.min("s").alias("ls"), F.max("e").alias("le"))
    to = lambda c: spans.genome_to_local(C(c), C("ls"), C("le"), C("strand"))
    back = lambda c: spans.local_to_genome(c, C("ls"), C("le"), C("strand"))
    a, b = back(to("s")), back(to("e"))
    return p.join(loc, ["copy", "contig", "strand"]).select("occ", F.least(a, b).alias("genome_start"), F.greatest(a, b).alias("genome_end"), spans.overlap_length(C("s"), C("e"), C("ls"), C("le")).alias("shared"))


@query(f"""WITH {S}, p AS (SELECT doc_id, substring(seq, 1, 40) AS q, right(seq, 40) AS t FROM sq WHERE length(seq) >= 40), c AS (SELECT doc_id, substring(q, 1, 10) || substring(q, 11, 5) || substring(q, 16, 10) || '-----' || substring(q, 26, 15) AS qr, substring(t, 1, 10) || '-----' || substring(t, 11, 10) || substring(t, 21, 5) || substring(t, 26, 15) AS tr FROM p)
SELECT doc_id, qr AS query_row, tr AS target_row, 35::BIGINT AS pairs, list_sum(list_transform(list_zip(string_split(qr, ''), string_split(tr, '')), lambda x: CASE WHEN x[1] = x[2] AND x[1] <> '-' THEN 1 ELSE 0 END))::BIGINT AS same FROM c""")
def cigar_columns(spark, d):
    """Gapped rows of two ends of a sequence aligned by a given string, and their common bases."""
    p = sequences(spark, d).filter(F.length("seq") >= 40).select("doc_id", F.substring("seq", 1, 40).alias("q"), F.substring("seq", -40, 40).alias("t"))
    c = p.select("doc_id", rules.cigar_columns(C("q"), C("t"), F.lit("10M5I10M5D15M")).alias("c"))
    return c.select("doc_id", C("c.q").alias("query_row"), C("c.t").alias("target_row"), rules.paired_support(C("c.q"), C("c.t")).alias("p")).select("doc_id", "query_row", "target_row", C("p.pairs").cast("bigint").alias("pairs"), C("p.same").cast("bigint").alias("same"))


@query(f"""WITH {MATCH}, c AS (SELECT match_id, {CIGAR} AS cigar FROM m), n AS (SELECT match_id, regexp_extract(cigar, '^([0-9]+)M', 1)::INT AS a, regexp_extract(cigar, 'M([0-9]+)I', 1)::INT AS b FROM c) SELECT match_id, a + 1 AS query_start, a + b AS query_end, a AS previous_target_end, a + 1 AS next_target_start FROM n""")
def cigar_gaps(spark, d):
    g = cigars(spark, d).select("match_id", F.explode(rules.query_gaps(C("cigar"))).alias("g"))
    return g.select("match_id", "g.query_start", "g.query_end", "g.previous_target_end", "g.next_target_start")


@query(f"WITH {MATCH} SELECT match_id, coalesce(status, '') AS st, 'a:b' AS sp FROM m")
def paf_tags(spark, d):
    line = F.concat(F.lit("q\t1\tst:Z:"), F.coalesce("status", F.lit("")), F.lit("\tsp:Z:x\tnone\tsp:Z:a:b"))
    return matches(spark, d).select("match_id", rules.paf_tags(line).alias("m")).select("match_id", C("m")["st"].alias("st"), C("m")["sp"].alias("sp"))


@query(f"WITH {HOM} SELECT record_no, round(greatest(0, CASE WHEN greatest(100, cs) > least(300, ce) THEN 0 ELSE least(least(300, ce) + 10, 250) - greatest(greatest(100, cs) + 10, 150) + 1 END) / 201, 6) + 0.0 AS coverage FROM h WHERE cs IS NOT NULL AND ce IS NOT NULL")
def projected_coverage(spark, d):
    h = homology(spark, d).filter("cs IS NOT NULL AND ce IS NOT NULL")
    block = F.array(F.struct(C("cs").cast("bigint").alias("q1"), C("ce").cast("bigint").alias("q2"), (C("cs") + 10).cast("bigint").alias("t1"), (C("ce") + 10).cast("bigint").alias("t2")))
    return h.select("record_no", r6(rules.projected_coverage(block, F.lit(100), F.lit(300), F.lit(150), F.lit(250))).alias("coverage"))


@query(f"""WITH {PLACED}, b AS (SELECT copy, s, e, max(e) OVER (PARTITION BY copy ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM (SELECT DISTINCT copy, s, e FROM placed WHERE strand = '+')) SELECT copy, sum(greatest(0, e - greatest(s - 1, coalesce(reach, 0))))::BIGINT AS covered FROM b GROUP BY copy""")
def block_union_length(spark, d):
    """Positions covered by the blocks of a copy, from their array."""
    p = placed(spark, d).filter("strand = '+'").select("copy", C("s").alias("start"), C("e").alias("end")).distinct()
    return p.groupBy("copy").agg(spans.blocks_length(F.collect_list(F.struct("start", "end"))).alias("covered"))


QUERIES, SQL = query.queries, query.sql
