"""Coordinates and small arrays of intervals, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def overlap_length(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Common positions of two closed intervals."""
    return F.greatest(F.lit(0), F.least(e1, e2) - F.greatest(s1, s2) + 1)


def to_half_open(start: Column) -> Column:
    return start - 1


def local_to_genome(at: Column, locus_start: Column, locus_end: Column, strand: Column) -> Column:
    """Genome position of a 1-based position inside a locus read on its strand."""
    return F.when(strand == "-", locus_end - at + 1).otherwise(locus_start + at - 1)


def genome_to_local(at: Column, locus_start: Column, locus_end: Column, strand: Column) -> Column:
    return F.when(strand == "-", locus_end - at + 1).otherwise(at - locus_start + 1)


def pad_clip(start: Column, end: Column, pad: int, length: Column) -> tuple[Column, Column]:
    """An interval widened on both sides and cut to 1..length."""
    return F.greatest(F.lit(1), start - pad), F.least(length, end + pad)


def format_blocks(blocks: Column) -> Column:
    """Sorted ``a-b;c-d`` of an array of (start, end), NA if empty."""
    text = F.array_join(F.transform(F.array_sort(blocks), lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string"))), ";")
    return F.when(F.size(blocks) > 0, text).otherwise("NA")


def parse_blocks(text: Column) -> Column:
    """Array of (start, end) from ``a-b;c-d``; parts of another shape are left out."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), ";"), lambda x: x.rlike("^[0-9]+-[0-9]+$"))
    return F.transform(parts, lambda x: F.struct(F.split_part(x, F.lit("-"), F.lit(1)).cast("bigint").alias("start"), F.split_part(x, F.lit("-"), F.lit(2)).cast("bigint").alias("end")))


def parse_locus(text: Column) -> dict[str, Column]:
    """contig, start, end and strand of ``contig:start-end:strand``, read from the right."""
    pattern = "^(.*):([0-9]+)-([0-9]+):([^:]*)$"
    return {n: F.regexp_extract(text, pattern, i) for i, n in enumerate(("contig", "start", "end", "strand"), 1)}


def blocks_overlap(a: Column, b: Column) -> Column:
    return F.exists(a, lambda x: F.exists(b, lambda y: (x["start"] <= y["end"]) & (y["start"] <= x["end"])))


def blocks_length(blocks: Column) -> Column:
    """Positions covered by an array of closed intervals that may overlap."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("reach"))
    step = lambda s, x: F.struct((s["n"] + F.greatest(F.lit(0).cast("bigint"), x["end"] - F.greatest(x["start"] - 1, s["reach"]))).alias("n"), F.greatest(s["reach"], x["end"]).alias("reach"))
    return F.aggregate(F.array_sort(blocks), zero, step, lambda s: s["n"])


def subtract_window(blocks: Column, start: Column, end: Column) -> Column:
    """Parts of the blocks that lie outside a window."""
    def piece(lo: Column, hi: Column) -> Column:
        return F.struct(lo.cast("bigint").alias("start"), hi.cast("bigint").alias("end"))

    left = F.transform(blocks, lambda x: piece(x["start"], F.least(x["end"], start - 1)))
    right = F.transform(blocks, lambda x: piece(F.greatest(x["start"], end + 1), x["end"]))
    return F.filter(F.array_distinct(F.concat(left, right)), lambda x: x["start"] <= x["end"])
