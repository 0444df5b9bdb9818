"""Classifiers and scores of single rows, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from branchloom.functions.values import key, number

# States that say nothing.
UNKNOWN = ("", ".", "na", "?", "unknown", "ambiguous", "truncated", "unavailable", "unresolved")
# Roles of transcribed segments, and of those between them.
EXON_LIKE = ("cds", "exon", "utr", "noncoding_exon")
NONCODING = ("intron", "intergenic")
ROLE_ALIASES = {"predicted_cds": "cds"}
# Confidence words and weights of the score components with the value of a missing one.
CONFIDENCE = {"high": 0.95, "strong": 0.95, "curated": 0.95, "medium": 0.75, "moderate": 0.75, "low": 0.45, "weak": 0.45}
WEIGHTS = {"identity": 0.34, "coverage": 0.14, "left": 0.10, "right": 0.10, "boundary": 0.10, "phase": 0.08, "order": 0.06, "strand": 0.04, "splice": 0.04}
MISSING_PART = {"identity": 0.0, "coverage": 1.0, "left": 0.5, "right": 0.5, "boundary": 0.5, "phase": 0.5, "order": 0.5, "strand": 0.5, "splice": 0.5}
# Acceptance thresholds.
COVERAGE, LOW_COVERAGE, EXTRA_IDENTITY = 0.45, 0.30, 0.15
SHORT_IDENTITY, SHORT_COVERAGE, SHORT_PAIRS = 0.70, 0.80, 12
MICRO_IDENTITY, MICRO_COVERAGE, MICRO_PAIRS = 0.90, 0.95, 3


def state(c: Column | str) -> Column:
    """The state as given, ``unknown`` for every word that says nothing."""
    t = key(c)
    return F.when(t.isNull() | t.isin(*UNKNOWN), "unknown").otherwise(t)


def role(c: Column | str) -> Column:
    """Role with predicted ones under their plain name."""
    t = key(c)
    for alias, plain in ROLE_ALIASES.items():
        t = F.when(t == alias, plain).otherwise(t)
    return t


def role_bucket(c: Column | str) -> Column:
    """CDS, exon_or_UTR, non_exonic_source or unknown."""
    t = role(c)
    return F.when(t == "cds", "CDS").when(t.isin("exon", "utr", "noncoding_exon"), "exon_or_UTR").when(t.isin(*NONCODING), "non_exonic_source").otherwise("unknown")


def feature_role(c: Column | str) -> Column:
    """Role of an annotation feature by its type: CDS, UTR, intron, else exon."""
    t = key(c)
    return F.when(t == "cds", "CDS").when(t.isin("utr", "five_prime_utr", "three_prime_utr"), "UTR").when(t == "intron", "intron").otherwise("exon")


def confidence(c: Column | str) -> Column:
    """Confidence word or number; 0.5 where neither."""
    t = key(c)
    out = F.when(t.isin(*CONFIDENCE), F.element_at(F.create_map(*[F.lit(x) for kv in CONFIDENCE.items() for x in kv]), t))
    return F.coalesce(out.otherwise(number(c)), F.lit(0.5))


def membership(conf: Column, degree: Column) -> Column:
    """Confidence adjusted by how many links support it, at most 1."""
    return F.least(F.lit(1.0), 0.75 * conf + 0.25 * F.least(F.lit(1.0), degree / 2))


def boundary(left: Column, right: Column, given: Column | None = None) -> Column:
    """The boundary score given, else the mean of both sides, a missing one counting 0.5."""
    mean = 0.5 * (F.coalesce(left, F.lit(0.5)) + F.coalesce(right, F.lit(0.5)))
    return mean if given is None else F.coalesce(given, mean)


def weighted_total(parts: dict[str, Column]) -> Column:
    """Weighted sum of score components; one that is absent, missing or NaN counts as its MISSING_PART."""
    out = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        part = F.lit(MISSING_PART[name])
        if name in parts:
            part = F.coalesce(F.when(~F.isnan(parts[name]), parts[name]), part)
        out = out + weight * part
    return out


def roles_compatible(left: Column, right: Column) -> Column:
    """Equal roles, two transcribed ones, or two structural ones."""
    both = lambda names: left.isin(*names) & right.isin(*names)
    return F.coalesce((left == right) | both(EXON_LIKE) | both(EXON_LIKE + NONCODING), F.lit(False))


def class_threshold(base: Column, distance: Column) -> Column:
    """Identity threshold by distance class: stricter within 2, laxer beyond 4."""
    return F.when(distance <= 2, F.greatest(base, F.lit(0.75))).when(distance > 4, F.greatest(F.lit(0.45), base - 0.15)).otherwise(base)


def distance_tier(distance: Column) -> Column:
    return F.when(distance.isNull(), "tree_not_available").when(distance <= 2, "nearest_species_support").when(distance <= 4, "within_clade_support").otherwise("deep_tree_support")


def two_tier(identity: Column, coverage: Column, threshold: Column) -> Column:
    return ((identity >= threshold) & (coverage >= COVERAGE)) | ((identity >= threshold + EXTRA_IDENTITY) & (coverage >= LOW_COVERAGE))


def short_accept(identity: Column, coverage: Column, pairs: Column, threshold: Column, min_identity: Column | float = SHORT_IDENTITY, min_coverage: Column | float = SHORT_COVERAGE, anchored: Column | None = None) -> Column:
    """A short candidate must pass the plain rule and a stricter one; an anchored one of few pairs its own."""
    base = two_tier(identity, coverage, threshold)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    short = (identity >= F.greatest(lit(min_identity), threshold)) & (coverage >= lit(min_coverage)) & (pairs >= SHORT_PAIRS)
    if anchored is None:
        return base & short
    micro = (identity >= F.greatest(F.lit(MICRO_IDENTITY), threshold)) & (coverage >= MICRO_COVERAGE)
    return base & F.when(anchored & pairs.between(MICRO_PAIRS, SHORT_PAIRS - 1), micro).otherwise(short)


def phase_score(left: Column, right: Column) -> Column:
    return F.when(left.isNull() | right.isNull(), 0.6).when(left == right, 1.0).otherwise(0.1)


def context_score(left: Column, right: Column) -> Column:
    """Neighbour roles: 1 if equal, 0.5 if one says nothing or is the end of the path, 0.25 otherwise."""
    vague = lambda x: x.isNull() | x.isin("alternative", "unknown")
    return F.when(vague(left) | vague(right), 0.5).when(left == right, 1.0).when((left == "terminal") | (right == "terminal"), 0.5).otherwise(0.25)


def role_boundary_score(left: Column, right: Column) -> Column:
    """1 for equal roles, 0.75 within transcribed ones, 0.45 between a transcribed and an untranscribed one, else 0.25."""
    a, b = left.isin(*EXON_LIKE), right.isin(*EXON_LIKE)
    return F.when(left.eqNullSafe(right), 1.0).when(a & b, 0.75).when((a & right.isin(*NONCODING)) | (b & left.isin(*NONCODING)), 0.45).otherwise(0.25)


def expected_phase(length: Column, phase: Column) -> Column:
    """Phase at which the next coding segment must start."""
    return F.pmod(3 - F.pmod(length - phase, F.lit(3)), F.lit(3))


def phase_compatibility(left: Column, right: Column, coding_length: Column) -> Column:
    """compatible, incompatible or unknown: whether the next segment starts in the phase the left one leaves."""
    want = expected_phase(coding_length, left)
    return F.when(left.isNull() | right.isNull() | coding_length.isNull(), "unknown").when(coding_length < left, "incompatible").when(right == want, "compatible").otherwise("incompatible")


def motif_score(seq: Column) -> Column:
    """Score of an intron by its first and last two bases: 1 for GT-AG, 0.8 for GC-AG and AT-AC, 0.45 for half a motif, else 0.1; 0 for fewer than four bases."""
    s = F.upper(F.coalesce(seq, F.lit("")))
    donor, acceptor = F.substring(s, 1, 2), F.substring(s, -2, 2)
    pair = F.concat(donor, F.lit("-"), acceptor)
    return F.when(F.length(s) < 4, 0.0).when(pair == "GT-AG", 1.0).when(pair.isin("GC-AG", "AT-AC"), 0.8).when(donor.isin("GT", "GC", "AT") | acceptor.isin("AG", "AC"), 0.45).otherwise(0.1)


# Layers of states by the rule of their change costs.
PRESENCE_LAYERS = ("segment_presence", "adjacency_state", "element_presence", "element_adjacency_state")
ROLE_LAYERS = ("role_state", "element_role_state")


def transition_cost(layer: Column, source: Column, target: Column) -> Column:
    """Cost of a change of state, by layer."""
    either = lambda s: (source == s) | (target == s)
    presence = F.when((source == "absent") & (target == "present"), 2.0).when((source == "present") & (target == "absent"), 1.5).otherwise(2.5)
    return (
        F.when(source == target, 0.0).when(layer.isin(*PRESENCE_LAYERS), presence).when(layer.isin(*ROLE_LAYERS), F.when(either("absent"), 2.0).otherwise(1.0))
        .when(layer == "source_mixture", F.when(either("multi_source"), 2.0).otherwise(1.0)).when(layer == "copy_multiplicity", 1.5).otherwise(1.0)
    )


def emission(observed: Column, true_state: Column, states: tuple[str, ...], error: float = 0.05) -> Column:
    """Probability of what is observed given the true state; an observation outside of ``states`` says nothing, and none is below 1e-12."""
    return F.when(~observed.isin(*states), 1.0).when(observed == true_state, max(1e-12, 1.0 - error)).otherwise(max(1e-12, error / max(1, len(states) - 1)))


def scaled_position(position: Column, low: Column, high: Column, width: float, mirrored: Column) -> Column:
    """Position on a line of ``width``, mirrored where asked; 0 for an empty range."""
    at = F.when(high == low, F.lit(0.0)).otherwise((position - low) / (high - low) * width)
    return F.when(mirrored, width - at).otherwise(at)
