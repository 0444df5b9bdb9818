"""Scans of the text formats of comparative genomics, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from branchloom.functions.text import attribute
from branchloom.plans.lineage import collect_bounded

GFF_FIELDS = ["seqid", "source", "type", "start", "end", "score", "strand", "phase", "attributes"]


def read_tsv(spark: SparkSession, path: str, required: list[str], optional: list[str] | None = None) -> DataFrame:
    """Header-driven TSV (gzip by suffix), every column text; required columns must be there, absent optional ones are null, ragged rows fail the query."""
    df = spark.read.csv(path, sep="\t", header=True, inferSchema=False, mode="FAILFAST", quote="", nullValue="\0")
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("repeated column names")
    return df.select(*required, *[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in optional or []])


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """record_id (first word of the header), header and upper-case sequence; one record is one row, records are split by ``>`` at a line start."""
    raw = spark.read.text(path, lineSep="\n>")
    record = F.regexp_replace("value", "^>", "")
    head = F.trim(F.split_part(record, F.lit("\n"), F.lit(1)))
    seq = F.upper(F.regexp_replace(F.expr("substr(_r, instr(_r, '\n') + 1)"), r"\s", ""))
    d = raw.select(record.alias("_r"), head.alias("header")).filter(F.length(F.trim("_r")) > 0)
    return d.select(F.split_part("header", F.lit(" "), F.lit(1)).alias("record_id"), "header", F.when(F.instr("_r", "\n") > 0, seq).otherwise("").alias("sequence"))


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """GFF3 lines of nine fields; comments and other lines are left out; id, parent and name from the attributes."""
    parts = spark.read.text(path).filter(~F.col("value").startswith("#")).select(F.split("value", "\t").alias("p")).filter(F.size("p") == 9)
    cols = [F.col("p")[i].alias(n) if n not in ("start", "end", "phase") else F.col("p")[i].try_cast("bigint").alias(n) for i, n in enumerate(GFF_FIELDS)]
    d = parts.select(*cols)
    return d.withColumns({"id": attribute(F.col("attributes"), "id"), "parent": attribute(F.col("attributes"), "parent"), "name": attribute(F.col("attributes"), "name")})


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a fixed schema; a malformed line fails the query."""
    return spark.read.schema(schema).json(path, mode="FAILFAST")


def read_fasta_interval(records: DataFrame, record_id: str, start: int, end: int) -> DataFrame:
    """Closed 1-based interval of one record; a record that is too short fails the query."""
    inside = F.assert_true(F.length("sequence") >= end, F.lit("interval exceeds the record"))
    part = F.substring("sequence", F.lit(start), F.lit(end - start + 1))
    return records.filter(F.col("record_id") == record_id).select("record_id", F.when(inside.isNull(), part).alias("part"))


def parse_newick(text: str) -> list[tuple[str, str | None, str | None, float | None]]:
    """(node_id, parent_id, label, branch_length) rows of one Newick text, parents before children; inner nodes without label get n1, n2, ..."""
    rows: list[list] = []
    open_: list[int] = []
    at, n, current = 0, 0, None

    def new() -> int:
        rows.append([None, open_[-1] if open_ else None, None, None])
        return len(rows) - 1

    current = new()
    while at < len(text):
        ch = text[at]
        if ch == "(":
            open_.append(current)
            current = new()
            at += 1
        elif ch == ",":
            if not open_:
                raise ValueError("comma outside of a group")
            current = new()
            at += 1
        elif ch == ")":
            if not open_:
                raise ValueError("unbalanced groups")
            current = open_.pop()
            at += 1
        elif ch == ";":
            break
        elif ch == ":":
            end = at + 1
            while end < len(text) and text[end] not in "(),;:":
                end += 1
            rows[current][3] = float(text[at + 1 : end])
            at = end
        elif ch in "'\"":
            end = text.index(ch, at + 1)
            rows[current][2] = text[at + 1 : end]
            at = end + 1
        elif ch.isspace():
            at += 1
        else:
            end = at
            while end < len(text) and text[end] not in "(),;:":
                end += 1
            rows[current][2] = text[at:end].strip()
            at = end
    if open_:
        raise ValueError("unbalanced groups")
    names = []
    for label in (r[2] for r in rows):
        n += not label
        names.append(label or f"n{n}")
    if len(set(names)) != len(names):
        raise ValueError("repeated labels")
    return [(names[i], None if r[1] is None else names[r[1]], r[2], r[3]) for i, r in enumerate(rows)]


def read_newick(spark: SparkSession, path: str) -> DataFrame:
    """Tree rows of a file with one Newick tree; a tree is small, it is parsed on the driver."""
    text = "".join(r.value for r in collect_bounded(spark.read.text(path), 100_000, path))
    return spark.createDataFrame(parse_newick(text), "node_id string, parent_id string, label string, branch_length double")
