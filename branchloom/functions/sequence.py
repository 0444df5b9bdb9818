"""Nucleotide sequences and alignment strings, as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code in the order of bases T, C, A, G.
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product("TCAG", repeat=3), AMINO_ACIDS)}


def from_text(text: Column) -> Column:
    """A sequence from any text: its ASCII letters, spread over the four bases in turn."""
    letters = F.upper(F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z]", ""))
    return F.translate(letters, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ("ACGT" * 7)[:26])


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTUNacgtun", "TGCAANtgcaan"))


def strand_slice(seq: Column, start: Column, end: Column, strand: Column) -> Column:
    """Closed 1-based slice, cut to the sequence, read on the given strand."""
    lo = F.greatest(start, F.lit(1))
    hi = F.least(end, F.length(seq))
    part = F.substring(seq, lo, F.greatest(hi - lo + 1, F.lit(0)))
    return F.upper(F.when(strand == "-", reverse_complement(part)).otherwise(part))


def codons(seq: Column) -> Column:
    """Array of whole codons; a rest of one or two bases is dropped."""
    return F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(.{3})"), F.lit(1))


def translate_codons(seq: Column) -> Column:
    """Protein of a coding sequence; codons with other letters give X."""
    code = F.create_map(*[F.lit(x) for kv in CODONS.items() for x in kv])
    return F.array_join(F.transform(codons(seq), lambda c: F.coalesce(F.try_element_at(code, c), F.lit("X"))), "")


def bases(seq: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.upper(seq), "U", "T"), F.lit("(.)"), F.lit(1))


def same_positions(a: Column, b: Column) -> Column:
    """Positions, over the shorter length, at which both have the same known base; U equals T."""
    hits = F.filter(F.zip_with(bases(a), bases(b), lambda x, y: F.coalesce((x == y) & x.isin("A", "C", "G", "T"), F.lit(False))), lambda x: x)
    return F.size(hits)


def cigar_ops(cigar: Column) -> Column:
    """Array of (length, operation)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit("([0-9]+[MIDNSHPX=])"), F.lit(1)), lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("int").alias("n"), F.substring(x, -1, 1).alias("op")))


def cigar_length(cigar: Column, consuming: str) -> Column:
    """Total length of the operations in ``consuming``."""
    return F.aggregate(F.filter(cigar_ops(cigar), lambda x: F.lit(consuming).contains(x["op"])), F.lit(0), lambda s, x: s + x["n"])


def cigar_transpose(cigar: Column) -> Column:
    return F.translate(cigar, "ID", "DI")


def run_lengths(text: Column) -> Column:
    """Run-length code of a text, as ``3A1B``."""
    runs = F.regexp_extract_all(text, F.lit("((.)\\2*)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.length(r).cast("string"), F.substring(r, 1, 1))), "")
