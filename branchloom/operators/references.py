"""References to records that were not in force when the referring row was loaded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from branchloom.plans import skew
from branchloom.plans.lineage import materialize, release, rows_of

#: Bits per parent key. A filter over MAX_FILTER_BYTES isn't broadcast but joined by its blocks.
BITS_PER_KEY = 12
MAX_FILTER_BYTES = 32 << 20
#: A block is WORDS words of 64 bits; a key sets one bit in each of PROBES of them.
WORDS = 8
PROBES = 4


def _place(key: Column, i: int) -> tuple[Column, Column]:
    """Word and mask of a key's i-th probe; probe i uses the words i and i + PROBES."""
    h = F.shiftrightunsigned(F.xxhash64(F.lit(7), key), 14 * i)
    return (F.lit(i) + PROBES * h.bitwiseAND(F.lit(1))).cast("int"), F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright(h, 1).bitwiseAND(F.lit(63)).cast("int"))


def bloom_filter(keys: DataFrame, key: str, max_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """Blocked Bloom filter of ``keys`` as rows (block, w0 .. w7); it may be broadcast if it has at most ``max_bytes``.

    Every key sets PROBES bits in the one block its hash names.
    """
    keys = materialize(keys.select(F.col(key).alias("key")), "keys")
    blocks = max(1, -(-rows_of(keys) * BITS_PER_KEY // (64 * WORDS)))
    d = keys.select(F.pmod(F.xxhash64(F.lit(-1), F.col("key")), F.lit(blocks)).alias("block"), *[c.alias(f"{n}{i}") for i in range(PROBES) for n, c in zip("pm", _place(F.col("key"), i))])
    words = [F.bit_or(F.when(F.col(f"p{w % PROBES}") == w, F.col(f"m{w % PROBES}")).otherwise(F.lit(0).cast("bigint"))).alias(f"w{w}") for w in range(WORDS)]
    out = materialize(d.groupBy("block").agg(*words), "bloom")
    release(keys)
    out._blocks, out._small = blocks, blocks * WORDS * 8 <= max_bytes
    return out


def may_contain(df: DataFrame, key: str, bloom: DataFrame, out: str, hot_rows: int = skew.HOT_ROWS, salts: int = skew.SALTS) -> DataFrame:
    """Add ``out``: false proves that ``key`` is not in the filter. A filter of a bounded size is broadcast; a larger one is split by its blocks over the cluster."""
    d = df.withColumn("_block", F.pmod(F.xxhash64(F.lit(-1), F.col(key)), F.lit(bloom._blocks)))
    d = d.join(F.broadcast(bloom), F.col("_block") == F.col("block"), "left") if bloom._small else skew.salted_join(d, bloom, "_block", "block", "left", hot_rows, salts)
    found = F.col("block").isNotNull()
    for i in range(PROBES):
        word, mask = _place(F.col(key), i)
        found = found & (F.when(word == i, F.col(f"w{i}")).otherwise(F.col(f"w{i + PROBES}")).bitwiseAND(mask) != 0)
    return d.withColumn(out, F.coalesce(found, F.lit(False))).drop("_block", *bloom.columns)


def orphan_references(refs: DataFrame, parents: DataFrame, payload: list[str], max_bytes: int = MAX_FILTER_BYTES, hot_rows: int = skew.HOT_ROWS, salts: int = skew.SALTS) -> DataFrame:
    """References for which no parent row with the same id was in force at their time.

    ``refs`` has ref_id, at and the ``payload`` columns; ``parents`` has
    parent_id, since and until (null: still in force). A parent is in force
    at t if since <= t and until is null or > t. The result has ``payload``,
    ref_id and at, and ``proof``: 'filter' or 'join'.

    A broadcast Bloom filter of the parent keys proves definite orphans (one
    over ``max_bytes`` is joined by its blocks instead). The rest are written
    once and verified exactly in one merge of both sides by id and time: a
    reference holds if the largest ``until`` of the parent rows up to its time
    lies beyond it. Ids with more than ``hot_rows`` rows are cut into chunks
    along time, with the references of a chunk spread over ``salts``.

    Defined results: a null ref_id is no reference; a null ``at``, or parents
    whose ``since`` is null, can't be proved in force, so such a reference is
    an orphan; repeated references come out as often as they come in; no
    parents make every reference an orphan.
    """
    refs = refs.filter(F.col("ref_id").isNotNull()).select("ref_id", "at", *payload)
    forever = F.lit("9999-12-31 23:59:59").cast("timestamp_ntz").cast(parents.schema["since"].dataType)
    life = materialize(parents.filter(F.col("parent_id").isNotNull() & F.col("since").isNotNull()).groupBy("parent_id", "since").agg(F.max(F.coalesce("until", forever)).alias("until")), "life")
    bloom = bloom_filter(life.select("parent_id").distinct(), "parent_id", max_bytes)
    tested = materialize(may_contain(refs, "ref_id", bloom, "_maybe", hot_rows, salts), "tested")
    maybe = tested.filter("_maybe").drop("_maybe")
    proved = tested.filter("NOT _maybe").select(*payload, "ref_id", "at", F.lit("filter").alias("proof"))
    untimed = maybe.filter(F.col("at").isNull()).select(*payload, "ref_id", "at", F.lit("join").alias("proof"))
    timed = maybe.filter(F.col("at").isNotNull())
    right = life.select(F.col("parent_id").alias("ref_id"), F.col("since").alias("at"), *[F.lit(None).cast(refs.schema[c].dataType).alias(c) for c in payload], F.col("until"), F.lit(0).alias("_is_ref"))
    both = right.unionByName(timed.withColumns({"until": F.lit(None).cast(right.schema["until"].dataType), "_is_ref": F.lit(1)}))
    both._branchloom_rows = rows_of(life) + rows_of(tested)  # at most
    d, carried = skew.chunked(both, ["ref_id"], "at", hot_rows, salts)
    part: list[str] = []
    if carried:  # chunks of hot ids: references are spread, the few parent rows repeated
        part = ["_part"]
        spread = F.array(F.pmod(F.xxhash64(*[F.col(c) for c in payload], F.col("at")), F.lit(salts)).cast("int"))
        d = d.withColumn("_part", F.explode(F.when(F.col("_cut"), F.when(F.col("_is_ref") == 1, spread).otherwise(F.sequence(F.lit(0), F.lit(salts - 1)))).otherwise(F.array(F.lit(0)))))
    d = skew.running_max(d, ["ref_id"], [F.col("at"), F.col("_is_ref")], F.col("until"), "reach", carried, split=part)
    checked = d.filter((F.col("_is_ref") == 1) & (F.col("reach").isNull() | (F.col("reach") <= F.col("at"))))
    return proved.unionByName(checked.select(*payload, "ref_id", "at", F.lit("join").alias("proof"))).unionByName(untimed)


def orphan_report(refs: DataFrame, orphans: DataFrame, groups: list[str]) -> DataFrame:
    """Orphans and references per ``groups`` and calendar month of ``at``: n_refs, n_orphans, orphan_share (6 places).

    Repeated references must have been removed by the caller. A null ``at`` gives a null month.
    """
    month = F.date_format("at", "yyyy-MM").alias("month")
    all_refs = refs.filter(F.col("ref_id").isNotNull()).select(*groups, month, F.lit(0).alias("o"), F.lit(1).alias("r"))
    bad = orphans.select(*groups, month, F.lit(1).alias("o"), F.lit(0).alias("r"))
    return all_refs.unionByName(bad).groupBy(*groups, "month").agg(F.sum("r").alias("n_refs"), F.sum("o").alias("n_orphans")).withColumn("orphan_share", F.round(F.col("n_orphans") / F.col("n_refs"), 6))
