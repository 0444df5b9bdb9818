"""Sinks: TSV with NA for missing, FASTA, GFF3, JSON lines with finite numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_tsv(df: DataFrame, path: str, columns: list[str], gzip: bool = False) -> None:
    """Columns in the given order, nulls as NA."""
    out = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("NA")).alias(c) for c in columns])
    out.write.csv(path, sep="\t", header=True, quote="", compression="gzip" if gzip else "none")


def write_fasta(df: DataFrame, path: str, record_id: str, sequence: str, width: int = 60) -> None:
    wrapped = F.regexp_replace(F.col(sequence), f"(.{{{width}}})(?=.)", "$1\n")
    df.select(F.concat(F.lit(">"), F.col(record_id), F.lit("\n"), wrapped).alias("value")).write.text(path)


def write_gff(df: DataFrame, path: str) -> None:
    """Nine GFF3 fields; missing ones as a dot."""
    from branchloom.sources.readers import GFF_FIELDS

    df.select(F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in GFF_FIELDS]).alias("value")).write.text(path)


def finite(c: Column) -> Column:
    """NaN and infinite numbers as null."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def write_jsonl(df: DataFrame, path: str) -> None:
    numbers = [n for n, t in df.dtypes if t in ("double", "float")]
    df.withColumns({n: finite(F.col(n)) for n in numbers}).write.json(path)
