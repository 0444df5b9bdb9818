"""Rules that call, classify and name evidence and changes, and small codecs of blocks, tags and alignments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from branchloom.functions.scoring import EXON_LIKE

# States of the search interval in which evidence counts.
BOUNDED = ("ordered_double_flank_bounded_interval", "ordered_double_flank_empty_interval")
# Labels that name no source.
NO_SOURCE = ("", "na", "unknown", "unknown_source")
# Structural change classes outside of the core scope.
COPY_PATTERNS = ("copy_duplication_or_expansion", "copy_duplication_or_relocation", "copy_loss_or_collapse", "copy_multiplicity_shift", "retrocopy_or_dispersed_duplication_candidate")
ANNOTATION_PATTERNS = ("sequence_supported_annotation_gap", "annotation_or_alignment_evidence")
AMBIGUOUS_PATTERNS = ("ambiguous_paralogous_similarity",)
EXONIC_STATES, UNEXONIC_STATES = ("CDS", "exon_or_UTR"), ("non_exonic_source", "intron_or_noncoding")


def completion_call(c: dict[str, Column], score: Column, threshold: float = 0.55) -> Column:
    """Call of one piece of sequence evidence from its status, anchors, event, frame, roles and support score.

    ``c`` has evidence_status, anchor_status, event, frame, inferred_role, predicted_role and annotation_status.
    """
    enough = F.coalesce(score >= threshold, F.lit(False))
    hidden, conflict = c["evidence_status"] == "supports_hidden_segment", c["evidence_status"] == "conflicts_annotation"
    predicted, inferred = c["predicted_role"].isin(*EXON_LIKE), c["inferred_role"].isin(*EXON_LIKE)
    boundary = c["annotation_status"] == "protein_projection_boundary_conflict"
    found = F.when(c["event"] == "shifted_splice_site", "shifted_splice_site_candidate").when(c["event"] == "intron_deletion_joined_exon", "joined_exon_candidate").when(c["frame"] == "frameshift_or_stop_risk", "hidden_segment_with_frame_disruption").otherwise("hidden_segment_candidate")
    return (
        F.when(~F.coalesce(c["anchor_status"].isin(*BOUNDED), F.lit(False)), "ambiguous_evidence")
        .when(hidden & (c["event"] == "protein_cds_projection") & predicted & enough, "predicted_exon_candidate")
        .when(conflict & boundary & predicted & enough, "boundary_conflict_candidate")
        .when(hidden & inferred & enough, found)
        .when(conflict & inferred & enough, F.when(boundary, "boundary_conflict_candidate").otherwise("annotation_conflict_candidate"))
        .when(c["evidence_status"] == "supports_annotation", "supports_annotation")
        .when(c["evidence_status"] == "supports_absence", "supports_true_absence")
        .when(c["evidence_status"] == "homologous_sequence_candidate", "homologous_sequence_candidate")
        .otherwise("ambiguous_evidence")
    )


def completion_event_class(call: Column, event: Column) -> Column:
    """Structural class of a completion call."""
    return (
        F.when(event.isin("te_associated_exonization", "transposable_element_exonization"), "te_associated_exonization").when(event.isin("introner_insertion", "te_intron_gain"), "introner_or_te_intron_gain")
        .when(call == "hidden_segment_candidate", "sequence_supported_annotation_gap").when(call == "shifted_splice_site_candidate", "splice_boundary_shift")
        .when(call == "joined_exon_candidate", "segment_fusion_or_new_adjacency").when(call == "hidden_segment_with_frame_disruption", "pseudogenization_or_frame_disruption").otherwise("annotation_or_alignment_evidence")
    )


def event_type(layer: Column, parent: Column, child: Column) -> Column:
    """Name of a change between the states 0 and 1 of a layer."""
    gain = (parent == 0) & (child == 1)
    named = lambda stem: F.when(gain, f"{stem}_gain").otherwise(f"{stem}_loss")
    return F.when(parent == child, "no_change").when(layer == "splice_junction", named("intron")).when(layer == "exon_presence", named("sequence")).when(layer == "exon_role", named("exon_role")).otherwise(named("state"))


def structural_relation(layer: Column, within_exon: Column, parent: Column, child: Column) -> Column:
    """exon_split or exon_fusion for a junction inside one element, else NA."""
    inside = (layer == "splice_junction") & within_exon
    return F.when(inside & (parent == 0) & (child == 1), "exon_split").when(inside & (parent == 1) & (child == 0), "exon_fusion").otherwise("NA")


def branch_event_class(layer: Column, source: Column, target: Column) -> Column:
    """Structural class of a change of state on a branch."""
    presence = F.when((source == "absent") & (target == "present"), "segment_gain").when((source == "present") & (target == "absent"), "segment_loss").otherwise("element_presence_shift")
    role = F.when(source.isin(*UNEXONIC_STATES, "absent") & target.isin(*EXONIC_STATES), "exonization_candidate").when(source.isin(*EXONIC_STATES) & target.isin(*UNEXONIC_STATES), "coding_or_exonic_role_loss").otherwise("element_role_shift")
    joins = ((source == "absent") & target.isin("present", "copy_variable")) | ((source == "copy_variable") & (target == "present"))
    parts = ((source == "present") & target.isin("absent", "copy_variable")) | ((source == "copy_variable") & (target == "absent"))
    adjacency = F.when(joins, "segment_fusion_or_new_adjacency").when(parts, "segment_split_or_adjacency_loss").otherwise("adjacency_shift")
    copies = F.when(target == "tandem_multi_copy", "copy_duplication_or_expansion").when(target.isin("same_contig_multi_copy", "dispersed_multi_copy"), "copy_duplication_or_relocation").when((source == "tandem_multi_copy") & (target == "single_copy"), "copy_loss_or_collapse").otherwise("copy_multiplicity_shift")
    return (
        F.when(source.isNull() | target.isNull(), "ambiguous_structural_change").when(layer.isin("segment_presence", "element_presence"), presence).when(layer.isin("role_state", "element_role_state"), role)
        .when(layer.isin("adjacency_state", "element_adjacency_state"), adjacency).when(layer == "source_mixture", F.when(target == "multi_source", "chimeric_origin_or_source_mixing").otherwise("source_mixture_shift")).when(layer == "copy_multiplicity", copies).otherwise("structural_state_change")
    )


def call_scope(pattern: Column) -> Column:
    return F.when(pattern.isin(*AMBIGUOUS_PATTERNS), "ambiguous_evidence").when(pattern.isin(*COPY_PATTERNS), "copy_context").when(pattern.isin(*ANNOTATION_PATTERNS), "annotation_evidence").otherwise("core_structural_event")


def range_is_partial(text: Column, side: Column) -> Column:
    """Whether ``a,b`` tells of an uncertain boundary: two different parts, each a number or a dot; an open side must not be the far one."""
    left, right = F.trim(F.split_part(text, F.lit(","), F.lit(1))), F.trim(F.split_part(text, F.lit(","), F.lit(2)))
    two = text.rlike(r"^\s*(\.|[0-9]+)\s*,\s*(\.|[0-9]+)\s*$") & (left != right)
    return F.coalesce(two & F.when(left == ".", side != "end").when(right == ".", side != "start").otherwise(left.try_cast("bigint") < right.try_cast("bigint")), F.lit(False))


def split_labels(text: Column) -> Column:
    """Distinct, sorted source labels of a text split at ; , and | without those that name none."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;,|]"), lambda x: F.trim(x))
    return F.array_sort(F.array_distinct(F.filter(parts, lambda x: ~F.lower(x).isin(*NO_SOURCE))))


def feature_tokens(*parts: Column) -> Column:
    """Distinct tokens of identifier lists, each also by what follows its last colon."""
    from branchloom.functions.text import split_ids

    all_ = F.flatten(F.array(*[split_ids(p) for p in parts]))
    return F.array_sort(F.array_distinct(F.filter(F.concat(all_, F.transform(all_, lambda x: F.substring_index(x, ":", -1))), lambda x: x != "")))


def parse_block_pairs(text: Column) -> Column:
    """Array of (q1, q2, t1, t2) from ``q1-q2:t1-t2;...``; parts of another shape are left out."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.rlike("^[0-9]+-[0-9]+:[0-9]+-[0-9]+$"))
    at = lambda x, i: F.element_at(F.split(x, "[-:]"), i).cast("bigint")
    return F.transform(parts, lambda x: F.struct(at(x, 1).alias("q1"), at(x, 2).alias("q2"), at(x, 3).alias("t1"), at(x, 4).alias("t2")))


def format_block_pairs(blocks: Column) -> Column:
    text = F.array_join(F.transform(blocks, lambda b: F.format_string("%d-%d:%d-%d", b["q1"], b["q2"], b["t1"], b["t2"])), ";")
    return F.when(F.size(blocks) > 0, text).otherwise("NA")


def genomic_blocks(text: Column) -> Column:
    """Array of (contig, strand, start, end) from ``contig:start-end:strand;...``, read from the right; malformed parts are left out."""
    pattern = "^(.*):([0-9]+)-([0-9]+):([^:]*)$"
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.rlike(pattern))
    n = lambda x, i: F.regexp_extract(x, pattern, i).cast("bigint")
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, pattern, 1).alias("contig"), F.regexp_extract(x, pattern, 4).alias("strand"), F.least(n(x, 2), n(x, 3)).alias("start"), F.greatest(n(x, 2), n(x, 3)).alias("end")))


def blocks_overlap_status(a: Column, b: Column) -> Column:
    """true if blocks of one contig and strand overlap, null if they overlap but a strand is missing, else false."""
    meet = lambda x, y: (x["contig"] == y["contig"]) & ~x["contig"].isin("NA", ".", "") & (x["start"] <= y["end"]) & (y["start"] <= x["end"])
    signed = lambda x, y: x["strand"].isin("+", "-") & y["strand"].isin("+", "-")
    same = F.exists(a, lambda x: F.exists(b, lambda y: meet(x, y) & signed(x, y) & (x["strand"] == y["strand"])))
    open_ = F.exists(a, lambda x: F.exists(b, lambda y: meet(x, y) & ~signed(x, y)))
    return F.when(same, True).when(open_, None).otherwise(False)


def paf_tags(text: Column) -> Column:
    """Map of the optional ``tag:type:value`` fields of a tab-separated line; of a repeated tag the last one."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), "\t"), lambda x: x.rlike("^[^:]*:[^:]*:"))
    entry = lambda x: F.struct(F.substring_index(x, ":", 1).alias("k"), F.regexp_replace(x, "^[^:]*:[^:]*:", "").alias("v"))
    entries = F.transform(parts, entry)
    last = F.filter(entries, lambda e: F.element_at(F.filter(entries, lambda y: y["k"] == e["k"]), -1)["v"] == e["v"])
    return F.map_from_entries(F.array_distinct(last))


def cigar_columns(query: Column, target: Column, cigar: Column) -> Column:
    """Struct (q, t) of the gapped rows an alignment string spells, in one pass over its operations; null where it reaches beyond a sequence."""
    from branchloom.functions.sequence import cigar_ops

    zero = F.struct(F.lit("").alias("q"), F.lit("").alias("t"), F.lit(0).alias("i"), F.lit(0).alias("j"))

    def step(s: Column, x: Column) -> Column:
        both, ins, dele = x["op"].isin("M", "=", "X"), x["op"] == "I", x["op"].isin("D", "N")
        gap = F.repeat(F.lit("-"), x["n"])
        q = F.when(both | ins, F.substring(query, s["i"] + 1, x["n"])).when(dele, gap).otherwise("")
        t = F.when(both | dele, F.substring(target, s["j"] + 1, x["n"])).when(ins, gap).otherwise("")
        return F.struct(F.concat(s["q"], q).alias("q"), F.concat(s["t"], t).alias("t"), (s["i"] + F.when(both | ins | (x["op"] == "S"), x["n"]).otherwise(0)).alias("i"), (s["j"] + F.when(both | dele, x["n"]).otherwise(0)).alias("j"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda s: F.when((s["i"] <= F.length(query)) & (s["j"] <= F.length(target)), F.struct(s["q"].alias("q"), s["t"].alias("t"))))


def query_gaps(cigar: Column) -> Column:
    """Array of the insertions of an alignment string: query_start, query_end, previous_target_end, next_target_start, all 1-based from 1."""
    from branchloom.functions.sequence import cigar_ops

    kind = "array<struct<query_start:int,query_end:int,previous_target_end:int,next_target_start:int>>"
    zero = F.struct(F.lit(1).alias("q"), F.lit(1).alias("t"), F.array().cast(kind).alias("gaps"))

    def step(s: Column, x: Column) -> Column:
        both, ins = x["op"].isin("M", "=", "X"), x["op"] == "I"
        gap = F.struct(s["q"].alias("query_start"), (s["q"] + x["n"] - 1).alias("query_end"), (s["t"] - 1).alias("previous_target_end"), s["t"].alias("next_target_start"))
        return F.struct((s["q"] + F.when(both | ins | (x["op"] == "S"), x["n"]).otherwise(0)).alias("q"), (s["t"] + F.when(both | x["op"].isin("D", "N"), x["n"]).otherwise(0)).alias("t"), F.when(ins, F.concat(s["gaps"], F.array(gap))).otherwise(s["gaps"]).alias("gaps"))

    return F.aggregate(cigar_ops(cigar), zero, step, lambda s: s["gaps"])


def paired_support(a: Column, b: Column) -> Column:
    """Struct (pairs, same): positions at which both gapped rows have a known base, and at which it is the same."""
    z = F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: F.when(x.isin("A", "C", "G", "T") & y.isin("A", "C", "G", "T"), (x == y).cast("int")))
    known = F.filter(z, lambda v: v.isNotNull())
    return F.struct(F.size(known).alias("pairs"), F.size(F.filter(known, lambda v: v == 1)).alias("same"))


def projected_coverage(blocks: Column, q_start: Column, q_end: Column, t_start: Column, t_end: Column) -> Column:
    """Share of a query interval that blocks (q1, q2, t1, t2) project into a target interval."""
    def one(b: Column) -> Column:
        left, right = F.greatest(q_start, b["q1"]), F.least(q_end, b["q2"])
        low = b["t1"] + left - b["q1"]
        return F.when(left > right, F.lit(0)).otherwise(F.greatest(F.lit(0), F.least(low + right - left, t_end) - F.greatest(low, t_start) + 1))

    total = F.aggregate(blocks, F.lit(0).cast("bigint"), lambda s, b: s + one(b))
    return total / F.greatest(F.lit(1), q_end - q_start + 1)
