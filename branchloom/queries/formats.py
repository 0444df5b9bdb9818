"""Round trips through the text formats, and the streaming operators run over the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from branchloom.functions.values import key
from branchloom.plans.lineage import shared_folder
from branchloom.queries.registry import Registry, r6
from branchloom.queries.scalars import SEQ, sequences
from branchloom.queries.tables import table
from branchloom.queries.views import FEAT, HOM, features, homology, k
from branchloom.sources import readers, writers
from branchloom.streaming import events as stream

query = Registry()
C = F.col


def _place(spark, name):
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query(f"WITH {HOM} SELECT record_no::VARCHAR AS record_no, coalesce(homology, 'NA') AS homology, coalesce(occ, 'NA') AS occ, coalesce(cs::VARCHAR, 'NA') AS cs, NULL AS note FROM h")
def write_roundtrip(spark, d):
    """Homology as gzipped TSV and back; an optional column that isn't there is null."""
    path = _place(spark, "homology.tsv")
    writers.write_tsv(homology(spark, d), path, ["record_no", "homology", "occ", "cs"], gzip=True)
    return readers.read_tsv(spark, path, ["record_no", "homology", "occ", "cs"], ["note"])


@query(f"SELECT doc_id::VARCHAR AS record_id, s AS sequence FROM (SELECT doc_id, {SEQ} AS s FROM documents) WHERE s <> ''")
def scan_fasta_text(spark, d):
    path = _place(spark, "fasta")
    writers.write_fasta(sequences(spark, d).filter("seq <> ''"), path, "doc_id", "seq")
    return readers.read_fasta(spark, path).select("record_id", "sequence")


@query(f"WITH {FEAT} SELECT coalesce(seqid, '.') AS seqid, type, s AS start_, e AS end_, coalesce(strand, '.') AS strand, id AS gff_id, parent AS gff_parent FROM f WHERE id IS NOT NULL AND type IS NOT NULL")
def scan_gff_like(spark, d):
    path = _place(spark, "gff")
    f = features(spark, d).filter("id IS NOT NULL AND type IS NOT NULL")
    attrs = F.concat(F.lit("ID="), C("id"), F.coalesce(F.concat(F.lit(";Parent="), C("parent")), F.lit("")))
    writers.write_gff(f.select("seqid", "source", "type", C("s").alias("start"), C("e").alias("end"), F.lit(None).alias("score"), "strand", "phase", attrs.alias("attributes")), path)
    return readers.read_gff(spark, path).select("seqid", "type", C("start").alias("start_"), C("end").alias("end_"), "strand", C("id").alias("gff_id"), C("parent").alias("gff_parent"))


@query("SELECT event_id, CASE WHEN isfinite(value) THEN value END AS value FROM events")
def jsonl_roundtrip(spark, d):
    from pyspark.sql import types as T

    path = _place(spark, "jsonl")
    writers.write_jsonl(table(spark, d, "events").select("event_id", "value"), path)
    return readers.read_jsonl(spark, path, T.StructType().add("event_id", "long").add("value", "double"))


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(CASE WHEN NOT isnan(value) THEN value END), 6) + 0.0 AS value FROM events GROUP BY ALL")
def stream_windowed_counts(spark, d):
    """The windowed stream aggregate over the whole table, as a batch; tests run it as a stream."""
    e = table(spark, d, "events")
    return stream.windowed_counts(e.withColumn("ts", C("ts").cast("timestamp"))).select(C("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", r6(C("value")).alias("value"))


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events), g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS no FROM s) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM g GROUP BY user_id, no")
def stream_sessions(spark, d):
    e = table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp"))
    return stream.sessions(e).select("user_id", C("session_start").cast("timestamp_ntz").alias("session_start"), "n")


QUERIES, SQL = query.queries, query.sql
