"""Constants and classification rules, one by one, with values worked out by hand."""

import random

import pytest
from pyspark.sql import functions as F

from branchloom.functions import rules, scoring
from branchloom.operators.joins import overlap_join, reciprocal_best
from branchloom.operators.kernels import score_delta
from branchloom.operators.statistics import chi_square_sf1


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


def test_normalisers(spark):
    states = one(spark, *[scoring.state(F.lit(x).cast("string")) for x in (None, "NA", "?", "truncated", " Present", "absent", "uncertain")])
    assert states == ("unknown", "unknown", "unknown", "unknown", "present", "absent", "uncertain")
    assert one(spark, *[scoring.role_bucket(F.lit(x)) for x in ("CDS", "predicted_CDS", "UTR", "noncoding_exon", "intergenic", "gene")]) == ("CDS", "CDS", "exon_or_UTR", "exon_or_UTR", "non_exonic_source", "unknown")
    assert one(spark, *[scoring.feature_role(F.lit(x)) for x in ("CDS", "five_prime_UTR", "intron", "mRNA")]) == ("CDS", "UTR", "intron", "exon")
    assert one(spark, *[scoring.confidence(F.lit(x).cast("string")) for x in ("strong", "moderate", "weak", "1.7", "odd", None)]) == (0.95, 0.75, 0.45, 1.7, 0.5, 0.5)


def test_membership(spark):
    assert one(spark, scoring.membership(F.lit(0.75), F.lit(2)), scoring.membership(F.lit(0.5), F.lit(1)), scoring.membership(F.lit(1.7), F.lit(9))) == pytest.approx((0.8125, 0.5, 1.0))


def test_match_total_fills_missing_parts(spark):
    # 0.34 * 0 + 0.14 * 1 + 0.5 * (0.1 + 0.1 + 0.1 + 0.08 + 0.06 + 0.04 + 0.04)
    assert one(spark, scoring.weighted_total({}))[0] == pytest.approx(0.40)
    given = {"identity": F.lit(0.9), "coverage": F.lit(0.5), "left": F.lit(float("nan")), "boundary": scoring.boundary(F.lit(1.0), F.lit(None).cast("double"))}
    assert one(spark, scoring.weighted_total(given))[0] == pytest.approx(0.34 * 0.9 + 0.07 + 0.05 + 0.05 + 0.075 + 0.11)


def test_motifs_and_phases(spark):
    assert one(spark, *[scoring.motif_score(F.lit(x)) for x in ("GTxxAG", "gcAG", "ATxAC", "GTxxxx", "xxxxAC", "xxxx", "GAG")]) == (1.0, 0.8, 0.8, 0.45, 0.45, 0.1, 0.0)
    n = F.lit(None).cast("int")
    assert one(spark, scoring.phase_compatibility(F.lit(0), F.lit(0), F.lit(9)), scoring.phase_compatibility(F.lit(1), F.lit(2), F.lit(9)), scoring.phase_compatibility(F.lit(1), F.lit(1), F.lit(9)), scoring.phase_compatibility(n, F.lit(1), F.lit(9)), scoring.phase_compatibility(F.lit(2), F.lit(0), F.lit(1))) == ("compatible", "incompatible", "compatible", "unknown", "incompatible")


def test_acceptance(spark):
    two = lambda i, c: scoring.two_tier(F.lit(i), F.lit(c), F.lit(0.55))
    assert one(spark, two(0.55, 0.45), two(0.55, 0.4), two(0.71, 0.3), two(0.69, 0.3)) == (True, False, True, False)
    short = lambda i, c, n, a=None: scoring.short_accept(F.lit(i), F.lit(c), F.lit(n), F.lit(0.55), anchored=a)
    assert one(spark, short(0.7, 0.8, 12), short(0.69, 0.8, 12), short(0.95, 0.96, 5), short(0.95, 0.96, 5, F.lit(True)), short(0.89, 0.96, 5, F.lit(True)), short(0.7, 0.8, 12, F.lit(True))) == (True, False, False, True, False, True)


def test_places_and_tiers(spark):
    ctx = lambda a, b: scoring.context_score(F.lit(a), F.lit(b))
    assert one(spark, ctx("cds", "cds"), ctx("terminal", "cds"), ctx("alternative", "alternative"), ctx("cds", "intron")) == (1.0, 0.5, 0.5, 0.25)
    role = lambda a, b: scoring.role_boundary_score(F.lit(a), F.lit(b))
    assert one(spark, role("cds", "cds"), role("cds", "utr"), role("intron", "exon"), role("intron", "other")) == (1.0, 0.75, 0.45, 0.25)
    tier = lambda x: scoring.distance_tier(F.lit(x).cast("double"))
    assert one(spark, tier(2), tier(4), tier(4.1), tier(None)) == ("nearest_species_support", "within_clade_support", "deep_tree_support", "tree_not_available")
    assert score_delta(200.0, "nt_affine") == 10.0 and score_delta(10.0, "nt_affine") == 4.0 and score_delta(200.0, "aa") == 0.0


def test_changes(spark):
    cost = lambda layer, a, b: scoring.transition_cost(F.lit(layer), F.lit(a), F.lit(b))
    assert one(spark, cost("segment_presence", "absent", "present"), cost("element_presence", "present", "absent"), cost("segment_presence", "present", "unknown"), cost("role_state", "absent", "CDS"), cost("role_state", "CDS", "x"), cost("source_mixture", "a", "multi_source"), cost("copy_multiplicity", "a", "b"), cost("any", "a", "a")) == (2.0, 1.5, 2.5, 2.0, 1.0, 2.0, 1.5, 0.0)
    e = lambda o, t: scoring.emission(F.lit(o), F.lit(t), ("absent", "present"))
    assert one(spark, e("present", "present"), e("absent", "present"), e("odd", "present")) == (0.95, 0.05, 1.0)
    c = lambda layer, a, b: rules.branch_event_class(F.lit(layer), F.lit(a), F.lit(b))
    assert one(spark, c("segment_presence", "absent", "present"), c("role_state", "intron_or_noncoding", "CDS"), c("adjacency_state", "copy_variable", "absent"), c("source_mixture", "a", "multi_source"), c("copy_multiplicity", "tandem_multi_copy", "single_copy"), c("odd", "a", "b")) == ("segment_gain", "exonization_candidate", "segment_split_or_adjacency_loss", "chimeric_origin_or_source_mixing", "copy_loss_or_collapse", "structural_state_change")


def test_completion_calls(spark):
    base = {"evidence_status": "supports_hidden_segment", "anchor_status": rules.BOUNDED[0], "event": "", "frame": "", "inferred_role": "cds", "predicted_role": "cds", "annotation_status": ""}
    call = lambda score=0.6, **kw: rules.completion_call({k: F.lit(v) for k, v in (base | kw).items()}, F.lit(score).cast("double"))
    assert one(spark, call(), call(event="protein_cds_projection"), call(event="intron_deletion_joined_exon"), call(frame="frameshift_or_stop_risk"), call(score=0.5), call(anchor_status="unknown"), call(evidence_status="conflicts_annotation"), call(evidence_status="conflicts_annotation", annotation_status="protein_projection_boundary_conflict"), call(score=None, evidence_status="supports_absence")) == (
        "hidden_segment_candidate", "predicted_exon_candidate", "joined_exon_candidate", "hidden_segment_with_frame_disruption", "ambiguous_evidence", "ambiguous_evidence", "annotation_conflict_candidate", "boundary_conflict_candidate", "supports_true_absence")


def test_codecs(spark):
    assert one(spark, rules.format_block_pairs(rules.parse_block_pairs(F.lit("1-5:11-15;x;7-9:20-22"))), rules.format_block_pairs(rules.parse_block_pairs(F.lit("NA")))) == ("1-5:11-15;7-9:20-22", "NA")
    side = lambda t, s: rules.range_is_partial(F.lit(t), F.lit(s))
    assert one(spark, side(".,5", "start"), side(".,5", "end"), side("5,.", "end"), side("5,7", "end"), side("7,5", "end"), side("5,5", "end"), side("5", "end"), side(".,.", "start")) == (True, False, True, True, False, False, False, False)
    row = one(spark, rules.cigar_columns(F.lit("ACGT"), F.lit("AGTT"), F.lit("1M1I2M1D")), rules.query_gaps(F.lit("3M2I4M1D1I")), rules.cigar_columns(F.lit("AC"), F.lit("A"), F.lit("2M")))
    assert (row[0].q, row[0].t) == ("ACGT-", "A-GTT") and [tuple(g) for g in row[1]] == [(4, 5, 3, 4), (10, 10, 8, 9)] and row[2] is None


def test_overlap_join_with_nulls_and_long_intervals(spark):
    left = spark.createDataFrame([("g", 1, 10, None), ("g", 1, 10, None), ("g", 50, 60, "x"), (None, 1, 2, "y"), ("g", None, 5, "z")], "k string, s bigint, e bigint, note string")
    right = spark.createDataFrame([("g", 5, 6), ("h", 1, 100)], "k string, s bigint, e bigint")
    got = sorted((r.s or 0, r.note or "", r.r_s or 0) for r in overlap_join(left, right, ["k"], how="left").collect())
    assert got == [(0, "z", 0), (1, "", 5), (1, "", 5), (1, "y", 0), (50, "x", 0)]
    r = random.Random(3)
    rows = [("g", a := r.randrange(1, 2000), a + r.choice([0, 5, 90, 3000, 100_000_000])) for _ in range(150)]
    df = spark.createDataFrame(rows, "k string, s bigint, e bigint")
    want = sorted((a[1:], b[1:]) for a in rows for b in rows if a[1] <= b[2] and b[1] <= a[2])
    for size in (4, 10_000):
        assert sorted(((x.s, x.e), (x.r_s, x.r_e)) for x in overlap_join(df, df, ["k"], bin_size=size).collect()) == want


def test_reciprocal_best_counts_both_directions(spark):
    rows = [("a", "b", 0.9), ("c", "a", 0.95), ("c", "d", 0.5), ("d", "e", 0.5)]
    got = {(r.q, r.t): r.status for r in reciprocal_best(spark.createDataFrame(rows, "q string, t string, s double"), "q", "t", "s").collect()}
    assert got == {("a", "b"): "not_reciprocal_best", ("c", "a"): "reciprocal_best", ("c", "d"): "not_reciprocal_best", ("d", "e"): "query_best_only"} | {("d", "e"): "reciprocal_best"}


def test_chi_square(spark):
    got = [r.p for r in spark.createDataFrame([(None,), (0.0,), (3.841458820694124,), (-1.0,)], "x double").select(chi_square_sf1("x").alias("p")).collect()]
    assert got[0] is None and got[1:] == pytest.approx([1.0, 0.05, 1.0])
