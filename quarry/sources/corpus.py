"""Corpus, question and benchmark sources; exports and telemetry."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.storage import Store

DOCUMENT = (
    "doc_id string, source_type string, title string, body string, created_at string, modified_at string, author_or_sender string, recipients array<string>, "
    "people_mentions array<string>, project_mentions array<string>, tags array<string>, url_or_external_id string, thread_id string, parent_doc_id string, "
    "license string, provenance string, entity_ids array<struct<id: string, kind: string, surface: string>>"
)
QUESTION = "qa_id string, source string, source_type string, question string, answers array<string>, answer_type string, evidence_doc_ids array<string>, negative_doc_ids array<string>, relation_type string"


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Corpus documents of JSON lines, with an explicit schema; unreadable lines are dropped."""
    return spark.read.schema(DOCUMENT).option("mode", "DROPMALFORMED").json(path).filter("doc_id IS NOT NULL")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUESTION).option("mode", "DROPMALFORMED").json(path).filter("qa_id IS NOT NULL")


def nested_documents(records: DataFrame, key: str, parts: str, text: str, title: str) -> tuple[DataFrame, DataFrame]:
    """(documents, questions) of benchmark records that hold their passages in an array.

    A document's id is the record's key and the passage's position; news, dialogue and multi-hop sets differ only in
    the names of these fields.
    """
    docs = records.select(F.col(key).alias("question_id"), F.posexplode(parts).alias("idx", "p")).select("question_id", F.concat_ws("#", "question_id", "idx").alias("doc_id"), F.col(f"p.{title}").alias("title"), F.col(f"p.{text}").alias("body"), F.col("p.is_supporting").alias("is_supporting") if "is_supporting" in records.schema[parts].dataType.elementType.names else F.lit(None).cast("boolean").alias("is_supporting"))
    return docs, records.drop(parts)


def document_nodes(documents: DataFrame) -> DataFrame:
    """Nodes of documents: the source type is the kind, the doc_id both id and source."""
    return documents.select(F.col("doc_id").alias("logical_id"), F.col("source_type").alias("kind"), "body", F.col("doc_id").alias("source_id"), F.lit("active").alias("state"))


def stable_lines(rows: DataFrame, order: str) -> DataFrame:
    """(line, digest): each row as JSON with sorted keys and the SHA-256 of its bytes, so equal tables give equal files."""
    line = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))
    return rows.select(F.col(order), line.alias("line")).withColumn("digest", F.sha2("line", 256))


def _digests(spark: SparkSession, out: str, table: str) -> DataFrame:
    """(file, digest) of a table's Parquet files, hashed where they are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(f"{out}/{table}")
    return files.select(F.concat(F.lit(f"{table}/"), F.element_at(F.split("path", "/"), -1)).alias("file"), F.sha2("content", 256).alias("digest"))


def export(spark: SparkSession, tables: dict[str, DataFrame], out: str) -> dict:
    """Parquet of every table with a manifest of row counts and file digests; a folder that exists is refused.

    The driver holds the manifest, a line per file.
    """
    store = Store(spark, out)
    if store.exists():
        raise FileExistsError(out)
    manifest = {}
    for name, t in tables.items():
        t.write.parquet(store.at(name))
        manifest[name] = {"rows": spark.read.schema(t.schema).parquet(store.at(name)).count(), "files": {r.file: r.digest for r in _digests(spark, store.at(), name).collect()}}
    store.write_new("manifest.json", json.dumps(manifest, sort_keys=True, indent=1))
    return manifest


def verify_export(spark: SparkSession, out: str) -> list[str]:
    """Files whose digest isn't the manifest's."""
    store = Store(spark, out)
    manifest = json.loads(store.read("manifest.json"))
    found = {r.file: r.digest for name in manifest for r in _digests(spark, store.at(), name).collect()}
    return sorted(f for t in manifest.values() for f, d in t["files"].items() if found.get(f) != d)


EVENT = "type string, query_id string, schema_version int, query_chars int, result_ids array<long>, arm_of map<string,string>, relevant_ids array<long>, irrelevant_ids array<long>, label_source string"


def telemetry_events(results: DataFrame) -> DataFrame:
    """One event per query of (query_id, query_chars, doc, rank, branch): ids, arms and lengths, never text."""
    listed = F.array_sort(F.collect_list(F.struct("rank", "doc", "branch")))
    grouped = results.groupBy("query_id", "query_chars").agg(listed.alias("r"))
    return grouped.select(F.lit("event").alias("type"), "query_id", F.lit(1).alias("schema_version"), "query_chars", F.col("r.doc").alias("result_ids"), F.map_from_entries(F.transform("r", lambda x: F.struct(x["doc"].cast("string"), x["branch"]))).alias("arm_of"))


def gold_records(log: DataFrame, order: str) -> DataFrame:
    """(query_id, candidate_ids, query_chars, labels): each feedback with the latest unpaired event of its query before it.

    Within a query events open and feedbacks close like brackets, so a feedback's event is the last one at the same
    nesting depth; feedback without an open event is dropped.  An id in both lists is irrelevant.
    """
    valid = log.filter("query_id IS NOT NULL AND query_id != '' AND type IN ('event', 'feedback')")
    w = Window.partitionBy("query_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sign = F.when(F.col("type") == "event", 1).otherwise(-1)
    # Feedback that would fall below zero is an orphan: shift the depth by the least sum so far.
    total = F.sum(sign).over(w)
    counted = valid.withColumn("total", total).withColumn("floor", F.least(F.min("total").over(w), F.lit(0)))
    before = F.coalesce(F.lag("floor").over(Window.partitionBy("query_id").orderBy(order)), F.lit(0))
    placed = counted.withColumn("orphan", (F.col("type") == "feedback") & (F.col("floor") < before)).filter("NOT orphan").withColumn("depth", F.col("total") - F.col("floor") + F.when(F.col("type") == "feedback", 1).otherwise(0))
    same = Window.partitionBy("query_id", "depth").orderBy(order)
    paired = placed.withColumn("event", F.lag(F.struct("result_ids", "query_chars", "type")).over(same)).filter("type = 'feedback' AND event.type = 'event'")
    bad = F.coalesce("irrelevant_ids", F.array().cast("array<long>"))
    good = F.array_except(F.coalesce("relevant_ids", F.array().cast("array<long>")), bad)
    labels = F.map_from_entries(F.concat(F.transform(F.array_distinct(good), lambda i: F.struct(i.alias("id"), F.lit(1).alias("label"))), F.transform(F.array_distinct(bad), lambda i: F.struct(i.alias("id"), F.lit(0).alias("label")))))
    return paired.select("query_id", F.col("event.result_ids").alias("candidate_ids"), F.col("event.query_chars").alias("query_chars"), labels.alias("labels"))


def cache_misses(wanted: DataFrame, cache: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``wanted`` whose content key (document, model, prompt version; or body) isn't cached."""
    return wanted.join(cache.select(*key).distinct(), key, "left_anti")
