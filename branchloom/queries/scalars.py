"""Row-wise operators: normalisers, classifiers, scores, coordinates, sequences and attribute texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from branchloom.functions import scoring, sequence, spans, text
from branchloom.functions.values import key, number
from branchloom.queries.registry import Registry, r6
from branchloom.queries.tables import table
from branchloom.queries.views import ADJ, FEAT, HOM, MATCH, OCC, PLACED, adjacencies, features, homology, k, matches, occurrences, placed

query = Registry()
C = F.col
STATE = "CASE WHEN {0} IS NULL OR {0} IN ('?', 'unknown', 'ambiguous', 'truncated', 'unavailable', 'unresolved') THEN 'unknown' ELSE {0} END"
ROLE = "CASE WHEN {0} IN ('cds', 'predicted_cds') THEN 'CDS' WHEN {0} IN ('exon', 'utr', 'noncoding_exon') THEN 'exon_or_UTR' WHEN {0} IN ('intron', 'intergenic') THEN 'non_exonic_source' ELSE 'unknown' END"
CONF = "coalesce(CASE WHEN {0} IN ('high', 'strong', 'curated') THEN 0.95 WHEN {0} IN ('medium', 'moderate') THEN 0.75 WHEN {0} IN ('low', 'weak') THEN 0.45 ELSE try_cast({0} AS DOUBLE) END, 0.5)"


@query(f"WITH {OCC} SELECT occ, loaded_at, {STATE.format('presence')} AS state FROM occ")
def norm_state(spark, d):
    return occurrences(spark, d).select("occ", "loaded_at", scoring.state("presence").alias("state"))


@query(f"WITH {HOM} SELECT record_no, coalesce(try_cast(confidence AS DOUBLE), -1.0) AS value FROM h")
def lenient_cast(spark, d):
    return homology(spark, d).select("record_no", F.coalesce(number("confidence"), F.lit(-1.0)).alias("value"))


@query(f"WITH {OCC} SELECT {ROLE.format('role')} AS bucket, role, count(*) AS n FROM occ GROUP BY ALL")
def role_bucket(spark, d):
    return occurrences(spark, d).groupBy(scoring.role_bucket("role").alias("bucket"), "role").agg(F.count("*").alias("n"))


@query(f"WITH {FEAT} SELECT type, CASE WHEN type = 'cds' THEN 'CDS' WHEN type LIKE '%utr' THEN 'UTR' WHEN type = 'intron' THEN 'intron' ELSE 'exon' END AS feature_role, count(*) AS n FROM f GROUP BY ALL")
def feature_role(spark, d):
    return features(spark, d).groupBy("type", scoring.feature_role("type").alias("feature_role")).agg(F.count("*").alias("n"))


@query(f"WITH {HOM} SELECT record_no, {CONF.format('confidence')} AS score FROM h")
def confidence_score(spark, d):
    return homology(spark, d).select("record_no", scoring.confidence("confidence").alias("score"))


@query(f"""WITH {HOM}, deg AS (SELECT homology, count(DISTINCT occ) AS degree FROM h WHERE homology IS NOT NULL GROUP BY homology),
s AS (SELECT record_no, least(1.0, 0.75 * {CONF.format('confidence')} + 0.25 * least(1.0, degree / 2)) AS x FROM h JOIN deg USING (homology))
SELECT record_no, round(x, 6) + 0.0 AS adjusted, CASE WHEN round(x, 6) >= 0.7 THEN 'core_member' ELSE 'ambiguous_member' END AS call FROM s""")
def membership_call(spark, d):
    h = homology(spark, d).filter("homology IS NOT NULL")
    degree = h.groupBy("homology").agg(F.count_distinct("occ").alias("degree"))
    x = r6(scoring.membership(scoring.confidence("confidence"), C("degree")))
    return h.join(degree, "homology").select("record_no", x.alias("adjusted"), F.when(x >= 0.7, "core_member").otherwise("ambiguous_member").alias("call"))


ELEMENT = "'EG_' || CASE WHEN {0} LIKE 'hc\\_%' ESCAPE '\\' OR {0} LIKE 'hsg\\_%' ESCAPE '\\' OR {0} LIKE 'h\\_%' ESCAPE '\\' THEN substring({0}, position('_' IN {0}) + 1) ELSE {0} END"


@query(f"WITH {HOM} SELECT record_no, {ELEMENT.format('homology')} AS element_id FROM h")
def id_rewrite(spark, d):
    return homology(spark, d).select("record_no", text.element_id(C("homology")).alias("element_id"))


_TIER = "((alignment_score >= 0.7 AND size_ratio >= 0.45) OR (alignment_score >= 0.85 AND size_ratio >= 0.3))"


@query(f"WITH {MATCH} SELECT match_id, coalesce({_TIER}, false) AS accepted FROM m")
def two_tier_accept(spark, d):
    return matches(spark, d).select("match_id", F.coalesce(scoring.two_tier(C("alignment_score"), C("size_ratio"), F.lit(0.7)), F.lit(False)).alias("accepted"))


_PAIRS = "floor(size_ratio * 20)"


@query(f"""WITH {MATCH} SELECT identity, coverage, count(*) AS candidates, sum(CASE WHEN ((alignment_score >= 0.55 AND size_ratio >= 0.45) OR (alignment_score >= 0.7 AND size_ratio >= 0.3)) AND alignment_score >= identity AND size_ratio >= coverage AND {_PAIRS} >= 12 THEN 1 ELSE 0 END) AS accepted
FROM m CROSS JOIN (VALUES (0.6), (0.7), (0.8)) i(identity) CROSS JOIN (VALUES (0.6), (0.8)) c(coverage) GROUP BY identity, coverage""")
def threshold_grid(spark, d):
    """Short candidates accepted at each pair of thresholds, the saved pair threshold being 0.55."""
    grid = F.explode(F.array(*[F.struct(F.lit(i).alias("identity"), F.lit(c).alias("coverage")) for i in (0.6, 0.7, 0.8) for c in (0.6, 0.8)])).alias("g")
    m = matches(spark, d).select("alignment_score", "size_ratio", grid).select("alignment_score", "size_ratio", "g.*")
    ok = scoring.short_accept(C("alignment_score"), C("size_ratio"), F.floor(C("size_ratio") * 20), F.lit(0.55), C("identity"), C("coverage"))
    return m.groupBy("identity", "coverage").agg(F.count("*").alias("candidates"), F.sum(F.when(ok, 1).otherwise(0)).alias("accepted"))


_BOUNDARY = "0.5 * (coalesce(left_boundary_score, 0.5) + coalesce(right_boundary_score, 0.5))"
_TOTAL = f"0.34 * coalesce(alignment_score, 0) + 0.14 * coalesce(size_ratio, 1) + 0.1 * coalesce(left_context_score, 0.5) + 0.1 * coalesce(right_context_score, 0.5) + 0.1 * {_BOUNDARY} + 0.08 * 0.5 + 0.06 * 0.5 + 0.04 * 0.5 + 0.04 * 0.5"


@query(f"WITH {MATCH} SELECT match_id, round({_TOTAL}, 6) + 0.0 AS formula_score, round(coalesce(total_score, {_TOTAL}), 6) + 0.0 AS score FROM m")
def match_total(spark, d):
    parts = {"identity": C("alignment_score"), "coverage": C("size_ratio"), "left": C("left_context_score"), "right": C("right_context_score"), "boundary": scoring.boundary(C("left_boundary_score"), C("right_boundary_score"))}
    total = scoring.weighted_total(parts)
    return matches(spark, d).select("match_id", r6(total).alias("formula_score"), r6(F.coalesce("total_score", total)).alias("score"))


@query(f"WITH {MATCH} SELECT match_id, coalesce(alignment_score, 0) AS identity, coalesce(size_ratio, 1) AS coverage, coalesce(left_context_score, 0.5) AS left_context, coalesce(right_context_score, 0.5) AS right_context, {_BOUNDARY} AS boundary, 0.5 AS phase, 0.5 AS path_order, 0.5 AS strand, 0.5 AS splice, NULL::DOUBLE AS sequence_score, NULL::DOUBLE AS structural_context, least(coalesce(alignment_score, 0), coalesce(size_ratio, 1)) AS support FROM m")
def normalized_components(spark, d):
    """All components of a match with the values of missing ones; phase, order, strand and splice aren't in the table."""
    a, s = F.coalesce("alignment_score", F.lit(0.0)), F.coalesce("size_ratio", F.lit(1.0))
    half = [F.lit(0.5).alias(n) for n in ("phase", "path_order", "strand", "splice")]
    none = [F.lit(None).cast("double").alias(n) for n in ("sequence_score", "structural_context")]
    return matches(spark, d).select("match_id", a.alias("identity"), s.alias("coverage"), F.coalesce("left_context_score", F.lit(0.5)).alias("left_context"), F.coalesce("right_context_score", F.lit(0.5)).alias("right_context"), scoring.boundary(C("left_boundary_score"), C("right_boundary_score")).alias("boundary"), *half, *none, F.least(a, s).alias("support"))


@query(f"""WITH {MATCH}, {PLACED}, p AS (SELECT occ, family, species, copy, role, e - s + 1 AS n FROM placed), j AS (SELECT a.family AS lf, b.family AS rf, a.species || '/' || a.copy AS lc, b.species || '/' || b.copy AS rc, a.role AS lr, b.role AS rr, least(a.n, b.n) / greatest(a.n, b.n) AS ratio, a.occ AS lo, b.occ AS ro FROM m LEFT JOIN p a ON a.occ = m.q LEFT JOIN p b ON b.occ = m.t)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN lo IS NULL OR ro IS NULL THEN 'missing_sequence' WHEN lf IS DISTINCT FROM rf THEN 'different_family' WHEN lc = rc THEN 'same_copy_projection_only' WHEN lr = 'intron' AND rr = 'intron' THEN 'intron_intron_skipped'
WHEN coalesce(lr, '') NOT IN ('cds', 'exon', 'utr', 'noncoding_exon') AND coalesce(rr, '') NOT IN ('cds', 'exon', 'utr', 'noncoding_exon') AND ratio < 0.25 THEN 'length_ratio_prefilter' ELSE 'aligned_candidate' END AS reason FROM j) GROUP BY reason""")
def prefilter_reason(spark, d):
    """Why a pair is aligned or not. An occurrence without coordinates has no sequence, and none of the other tests can be made on it."""
    p = placed(spark, d).select("occ", "family", F.concat_ws("/", "species", "copy").alias("copy"), F.coalesce("role", F.lit("")).alias("role"), (C("e") - C("s") + 1).alias("n"))
    side = lambda x: p.select(*[C(c).alias(f"{x}_{c}") for c in p.columns])
    j = matches(spark, d).select("q", "t").join(side("l"), C("q") == C("l_occ"), "left").join(side("r"), C("t") == C("r_occ"), "left")
    ratio = F.least("l_n", "r_n") / F.greatest("l_n", "r_n")
    exonic = C("l_role").isin(*scoring.EXON_LIKE) | C("r_role").isin(*scoring.EXON_LIKE)
    reason = F.when(C("l_occ").isNull() | C("r_occ").isNull(), "missing_sequence").when(~C("l_family").eqNullSafe(C("r_family")), "different_family").when(C("l_copy") == C("r_copy"), "same_copy_projection_only").when((C("l_role") == "intron") & (C("r_role") == "intron"), "intron_intron_skipped").when(~exonic & (ratio < 0.25), "length_ratio_prefilter").otherwise("aligned_candidate")
    return j.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {MATCH} SELECT match_id, CASE WHEN splice IN ('conserved', 'novel_splice') THEN 'true' WHEN splice IN ('weak_donor', 'weak_acceptor') THEN 'false' ELSE 'legacy' END AS flag, status = 'mapped' AND coalesce(splice, '') NOT IN ('weak_donor', 'weak_acceptor') AS eligible FROM m WHERE status IS NOT NULL")
def edge_eligibility(spark, d):
    flag = F.when(C("splice").isin("conserved", "novel_splice"), "true").when(C("splice").isin("weak_donor", "weak_acceptor"), "false").otherwise("legacy")
    return matches(spark, d).filter("status IS NOT NULL").select("match_id", flag.alias("flag"), ((C("status") == "mapped") & ~F.coalesce("splice", F.lit("")).isin("weak_donor", "weak_acceptor")).alias("eligible"))


@query(f"WITH {HOM} SELECT record_no, greatest(ce - cs, 0) AS half_open_length, cs - 1 AS start0, coalesce(cs <= 200 AND ce >= 100, false) AS touches FROM h WHERE cs IS NOT NULL AND ce IS NOT NULL")
def coord_convert(spark, d):
    return homology(spark, d).filter("cs IS NOT NULL AND ce IS NOT NULL").select("record_no", F.greatest(C("ce") - C("cs"), F.lit(0)).alias("half_open_length"), spans.to_half_open(C("cs")).alias("start0"), ((C("cs") <= 200) & (C("ce") >= 100)).alias("touches"))


@query(f"""WITH {PLACED}, loc AS (SELECT copy, contig, strand, min(s) AS ls, max(e) AS le FROM placed GROUP BY ALL)
SELECT occ, CASE WHEN p.strand = '-' THEN le - e + 1 ELSE s - ls + 1 END AS local_start, CASE WHEN p.strand = '-' THEN le - s + 1 ELSE e - ls + 1 END AS local_end FROM placed p JOIN loc USING (copy, contig, strand)""")
def genome_to_local(spark, d):
    p = placed(spark, d)
    loc = p.groupBy("copy", "contig", "strand").agg(F.min("s").alias("ls"), F.max("e").alias("le"))
    at = lambda c: spans.genome_to_local(C(c), C("ls"), C("le"), C("strand"))
    return p.join(loc, ["copy", "contig", "strand"]).select("occ", F.least(at("s"), at("e")).alias("local_start"), F.greatest(at("s"), at("e")).alias("local_end"))


@query(f"""WITH {PLACED}, loc AS (SELECT copy, contig, strand, min(s) AS ls, max(e) AS le FROM placed GROUP BY ALL)
SELECT copy, contig, strand, greatest(1, ls - 500) AS padded_start, least(le + 500, 100000000) AS padded_end, contig || ':' || ls || '-' || le || ':' || strand AS header, le - ls + 1 AS locus_length FROM loc""")
def interval_pad_clip(spark, d):
    loc = placed(spark, d).groupBy("copy", "contig", "strand").agg(F.min("s").alias("ls"), F.max("e").alias("le"))
    lo, hi = spans.pad_clip(C("ls"), C("le"), 500, F.lit(100_000_000))
    head = F.concat(C("contig"), F.lit(":"), C("ls"), F.lit("-"), C("le"), F.lit(":"), C("strand"))
    parsed = spans.parse_locus(C("header"))
    return loc.select("copy", "contig", "strand", lo.alias("padded_start"), hi.alias("padded_end"), head.alias("header")).withColumn("locus_length", parsed["end"].cast("bigint") - parsed["start"].cast("bigint") + 1)


# sequences: the texts of documents, spread over the four bases
SEQ = "translate(upper(regexp_replace(coalesce(text, ''), '[^A-Za-z]', '', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'ACGTACGTACGTACGTACGTACGTAC')"
S = f"sq AS (SELECT doc_id, {SEQ} AS seq FROM documents)"
REV = "reverse(translate({0}, 'ACGTU', 'TGCAA'))"


def sequences(spark, d):
    return table(spark, d, "documents").select("doc_id", sequence.from_text(C("text")).alias("seq"))


@query(f"WITH {S} SELECT doc_id, {REV.format('seq')} AS rc FROM sq")
def revcomp(spark, d):
    return sequences(spark, d).select("doc_id", sequence.reverse_complement(C("seq")).alias("rc"))


@query(f"WITH {S} SELECT doc_id, length(seq) AS n, length(replace(seq, 'G', '')) AS without_g, round((2 * length(seq) - length(replace(seq, 'G', '')) - length(replace(seq, 'C', ''))) / nullif(length(seq), 0), 6) + 0.0 AS gc FROM sq")
def seq_length(spark, d):
    n = F.length("seq")
    left = lambda b: F.length(F.replace(C("seq"), F.lit(b), F.lit("")))
    return sequences(spark, d).select("doc_id", n.alias("n"), left("G").alias("without_g"), r6(F.try_divide(2 * n - left("G") - left("C"), n)).alias("gc"))


@query(f"WITH {S} SELECT doc_id, CASE WHEN doc_id % 2 = 1 THEN {REV.format('p')} ELSE p END AS part FROM (SELECT doc_id, substring(seq, 11, greatest(least(40, length(seq)) - 10, 0)) AS p FROM sq)")
def strand_slice(spark, d):
    return sequences(spark, d).select("doc_id", sequence.strand_slice(C("seq"), F.lit(11), F.lit(40), F.when(C("doc_id") % 2 == 1, "-").otherwise("+")).alias("part"))


_CODE = "CASE " + " ".join(f"WHEN '{c}' THEN '{a}'" for c, a in sequence.CODONS.items()) + " ELSE 'X' END"


@query(f"""WITH {S}, cod AS (SELECT doc_id, i, CASE c {_CODE.removeprefix('CASE ')} AS aa FROM (SELECT doc_id, i, substring(seq, 3 * i + 1, 3) AS c FROM (SELECT doc_id, seq, unnest(range(0, length(seq) // 3)) AS i FROM sq)))
SELECT doc_id, coalesce(string_agg(aa, '' ORDER BY i), '') AS protein FROM sq LEFT JOIN cod USING (doc_id) GROUP BY doc_id""")
def translate_codons(spark, d):
    return sequences(spark, d).select("doc_id", sequence.translate_codons(C("seq")).alias("protein"))


@query(f"WITH {S} SELECT doc_id, coalesce(list_sum(list_transform(list_zip(string_split(seq, ''), string_split({REV.format('seq')}, '')), lambda x: CASE WHEN x[1] = x[2] AND x[1] <> '' THEN 1 ELSE 0 END)), 0)::BIGINT AS matching FROM sq")
def ungapped_identity(spark, d):
    """Positions at which a sequence equals its own reverse complement."""
    return sequences(spark, d).select("doc_id", sequence.same_positions(C("seq"), sequence.reverse_complement(C("seq"))).cast("bigint").alias("matching"))


@query(f"WITH {S} SELECT doc_id, CASE WHEN length(seq) < 4 THEN 0.0 WHEN l = 'GT' AND r = 'AG' THEN 1.0 WHEN (l = 'GC' AND r = 'AG') OR (l = 'AT' AND r = 'AC') THEN 0.8 WHEN l IN ('GT', 'GC', 'AT') OR r IN ('AG', 'AC') THEN 0.45 ELSE 0.1 END AS score FROM (SELECT *, substring(seq, 1, 2) AS l, right(seq, 2) AS r FROM sq)")
def motif_score(spark, d):
    return sequences(spark, d).select("doc_id", scoring.motif_score(C("seq")).alias("score"))


# alignment strings built from match rows
CIGAR = "(CAST(coalesce(alignment_score, 0) * 100 AS INT) + 1) || 'M' || (CAST(coalesce(size_ratio, 0) * 10 AS INT) + 1) || 'I' || (CAST(coalesce(total_score, 0) * 10 AS INT) + 1) || 'D7M'"


def cigars(spark, d):
    n = lambda c, m: (F.rint(F.coalesce(c, F.lit(0.0)) * m).cast("int") + 1).cast("string")
    return matches(spark, d).select("match_id", F.concat(n("alignment_score", 100), F.lit("M"), n("size_ratio", 10), F.lit("I"), n("total_score", 10), F.lit("D7M")).alias("cigar"))


@query(f"""WITH {MATCH}, c AS (SELECT match_id, {CIGAR} AS cigar FROM m)
SELECT match_id, translate(cigar, 'ID', 'DI') AS transposed, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MI]', 1), lambda x: x::INT))::BIGINT AS query_length, list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MD]', 1), lambda x: x::INT))::BIGINT AS target_length, len(regexp_extract_all(cigar, '[A-Z]')) AS n_ops FROM c""")
def cigar_parse(spark, d):
    c = cigars(spark, d)
    return c.select("match_id", sequence.cigar_transpose(C("cigar")).alias("transposed"), sequence.cigar_length(C("cigar"), "MI").cast("bigint").alias("query_length"), sequence.cigar_length(C("cigar"), "MD").cast("bigint").alias("target_length"), F.size(sequence.cigar_ops(C("cigar"))).alias("n_ops"))


@query(f"""WITH {PLACED}, g AS (SELECT copy, occ, s, strand, upper(substring(coalesce(role, 'x'), 1, 1)) AS r, row_number() OVER (PARTITION BY copy ORDER BY s, occ) AS i FROM placed),
b AS (SELECT *, CASE WHEN r = lag(r) OVER (PARTITION BY copy ORDER BY i) THEN 0 ELSE 1 END AS new FROM g),
x AS (SELECT *, sum(new) OVER (PARTITION BY copy ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM b)
SELECT copy, string_agg(n || r, '' ORDER BY run) AS runs FROM (SELECT copy, run, r, count(*) AS n FROM x GROUP BY ALL) GROUP BY copy""")
def run_length(spark, d):
    """Order of roles along each copy, run-length coded."""
    p = placed(spark, d).withColumn("r", F.upper(F.substring(F.coalesce("role", F.lit("x")), 1, 1)))
    path = p.groupBy("copy").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "occ", "r"))), lambda x: x["r"]), "").alias("path"))
    return path.select("copy", sequence.run_lengths(C("path")).alias("runs"))


# attribute texts


@query(f"""SELECT attrs, nullif(trim(regexp_extract(attrs, '(?:^|;)\\s*[Pp][Aa][Rr][Ee][Nn][Tt]=([^;]*)', 1)), '') AS parent_attr, nullif(trim(regexp_extract(attrs, '(?:^|;)\\s*[Ss][Cc][Oo][Rr][Ee]=([^;]*)', 1)), '') AS score_attr, count(*) AS n FROM raw_gene_features WHERE attrs IS NOT NULL GROUP BY ALL""")
def attr_map(spark, d):
    f = table(spark, d, "raw_gene_features").filter("attrs IS NOT NULL")
    none = lambda c: F.when(c != "", c)
    return f.groupBy("attrs", none(text.attribute(C("attrs"), "parent")).alias("parent_attr"), none(text.attribute(C("attrs"), "score")).alias("score_attr")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT attrs, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(attrs, ';'), lambda x: trim(x)), lambda x: x <> ''))), ';') AS formatted FROM raw_gene_features WHERE attrs IS NOT NULL""")
def format_attrs(spark, d):
    return table(spark, d, "raw_gene_features").filter("attrs IS NOT NULL").select("attrs").distinct().select("attrs", text.format_attributes(C("attrs")).alias("formatted"))


@query(f"""WITH {FEAT} SELECT DISTINCT id, part AS parent_token FROM (SELECT id, unnest(string_split(replace(parents, ',', ';'), ';')) AS p FROM f WHERE parents IS NOT NULL AND id IS NOT NULL), LATERAL (SELECT trim(replace(p, '"', '')) AS part) WHERE part NOT IN ('', '.', 'na')""")
def split_ids(spark, d):
    return features(spark, d).filter("parents IS NOT NULL AND id IS NOT NULL").select("id", F.explode(text.split_ids(C("parents"))).alias("parent_token")).distinct()


@query(f"WITH {FEAT}, t AS (SELECT DISTINCT id, unnest(regexp_extract_all(id, '[a-z0-9]+')) AS token FROM f WHERE id IS NOT NULL) SELECT token, count(*) AS ids FROM t GROUP BY token")
def token_lookup(spark, d):
    """Inverted index: how many feature ids hold each token."""
    f = features(spark, d).filter("id IS NOT NULL").select("id").distinct()
    return f.select("id", F.explode(text.tokens(C("id"))).alias("token")).groupBy("token").agg(F.count("*").alias("ids"))


@query(f"WITH {OCC} SELECT DISTINCT family || '/' || species || '/' || coalesce(replace(copy, ' ', '%20'), '') AS character_id FROM occ WHERE family IS NOT NULL AND species IS NOT NULL")
def url_id(spark, d):
    return occurrences(spark, d).filter("family IS NOT NULL AND species IS NOT NULL").select(text.url_id(C("family"), C("species"), F.coalesce("copy", F.lit(""))).alias("character_id")).distinct()


@query("""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, CASE WHEN isnan(value) THEN NULL ELSE value END AS value FROM events""")
def json_records(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.when(~F.isnan("value"), C("value")).alias("value"))


@query(f"""WITH {PLACED} SELECT copy, string_agg(s || '-' || e, ';' ORDER BY s, e) AS blocks FROM (SELECT DISTINCT copy, s, e FROM placed) GROUP BY copy""")
def format_intervals(spark, d):
    p = placed(spark, d).select("copy", "s", "e").distinct()
    return p.groupBy("copy").agg(spans.format_blocks(F.collect_list(F.struct(C("s").alias("start"), C("e").alias("end")))).alias("blocks"))


@query(f"""WITH {PLACED}, w AS (SELECT copy, greatest(0, least(e, 5000000) - greatest(s, 1000001) + 1) AS inside, e - s + 1 AS n FROM (SELECT DISTINCT copy, s, e FROM placed)) SELECT copy, sum(inside)::BIGINT AS inside, sum(n - inside)::BIGINT AS outside FROM w GROUP BY copy""")
def interval_subtract(spark, d):
    """Positions of each interval inside and outside a window."""
    p = placed(spark, d).select("copy", "s", "e").distinct()
    block = F.array(F.struct(C("s").alias("start"), C("e").alias("end")))
    left = spans.subtract_window(block, F.lit(1_000_001), F.lit(5_000_000))
    outside = F.aggregate(left, F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"] + 1)
    return p.groupBy("copy").agg(F.sum(spans.overlap_length(C("s"), C("e"), F.lit(1_000_001), F.lit(5_000_000))).alias("inside"), F.sum(outside).alias("outside"))


@query(f"""WITH {FEAT}, c AS (SELECT DISTINCT parent, strand, coalesce(id, '') AS id, s, e, phase FROM f WHERE type = 'cds' AND parent IS NOT NULL AND strand IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL),
w AS (SELECT *, lead(phase) OVER o AS next_phase, lead(s) OVER o AS next_s FROM c WINDOW o AS (PARTITION BY parent, strand ORDER BY CASE WHEN strand = '-' THEN -e ELSE s END, CASE WHEN strand = '-' THEN -s ELSE e END, id, coalesce(phase, -1)))
SELECT parent, strand, s, e, id, phase, next_phase, CASE WHEN phase IS NULL OR next_phase IS NULL THEN 'unknown' WHEN e - s + 1 < phase THEN 'incompatible' WHEN next_phase = (3 - (e - s + 1 - phase) % 3) % 3 THEN 'compatible' ELSE 'incompatible' END AS compatibility FROM w WHERE next_s IS NOT NULL""")
def phase_compat(spark, d):
    """Each coding segment and the next one in the direction of transcription."""
    c = features(spark, d).filter("type = 'cds' AND parent IS NOT NULL AND strand IS NOT NULL AND s IS NOT NULL AND e IS NOT NULL").select("parent", "strand", F.coalesce("id", F.lit("")).alias("id"), "s", "e", "phase").distinct()
    along = [F.when(C("strand") == "-", -C("e")).otherwise(C("s")), F.when(C("strand") == "-", -C("s")).otherwise(C("e")), C("id"), F.coalesce("phase", F.lit(-1))]
    w = Window.partitionBy("parent", "strand").orderBy(*along)
    d_ = c.withColumns({"next_phase": F.lead("phase").over(w), "_n": F.lead("s").over(w)}).filter("_n IS NOT NULL")
    return d_.select("parent", "strand", "s", "e", "id", "phase", "next_phase", scoring.phase_compatibility(C("phase"), C("next_phase"), C("e") - C("s") + 1).alias("compatibility"))


_LAYERS = ["segment_presence", "role_state", "source_mixture", "copy_multiplicity", "other"]
_STATES = ["absent", "present", "unknown", "multi_source"]


@query(f"""WITH l(layer) AS (VALUES {", ".join(f"('{x}')" for x in _LAYERS)}), s(a) AS (VALUES {", ".join(f"('{x}')" for x in _STATES)})
SELECT layer, x.a AS source_state, y.a AS target_state, CASE WHEN x.a = y.a THEN 0.0 WHEN layer = 'segment_presence' THEN CASE WHEN x.a = 'absent' AND y.a = 'present' THEN 2.0 WHEN x.a = 'present' AND y.a = 'absent' THEN 1.5 ELSE 2.5 END WHEN layer = 'role_state' THEN CASE WHEN 'absent' IN (x.a, y.a) THEN 2.0 ELSE 1.0 END WHEN layer = 'source_mixture' THEN CASE WHEN 'multi_source' IN (x.a, y.a) THEN 2.0 ELSE 1.0 END WHEN layer = 'copy_multiplicity' THEN 1.5 ELSE 1.0 END AS cost,
CASE WHEN x.a NOT IN ('absent', 'present') THEN 1.0 WHEN x.a = y.a THEN 0.95 ELSE 0.05 END AS emission FROM l, s x, s y""")
def transition_cost(spark, d):
    grid = spark.createDataFrame([(layer, a, b) for layer in _LAYERS for a in _STATES for b in _STATES], "layer string, source_state string, target_state string")
    return grid.select("layer", "source_state", "target_state", scoring.transition_cost(C("layer"), C("source_state"), C("target_state")).alias("cost"), scoring.emission(C("source_state"), C("target_state"), ("absent", "present")).alias("emission"))


QUERIES, SQL = query.queries, query.sql
