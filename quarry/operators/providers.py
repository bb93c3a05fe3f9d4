"""External extraction and consolidation.

A provider is a command that reads one JSON request per line and writes one JSON result per line.  Documents go
to it by partition, so each executor runs its own.
"""

from __future__ import annotations

import hashlib
import json
import math
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.errors import ExtractionFailed
from quarry.functions.epochs import epoch, malformed
from quarry.operators.prefix import following


def entity_id(kind: str, name: str) -> str:
    """The id of an entity: SHA-256 of kind and name in lower case, joined by a colon."""
    if ":" in kind or not name:
        raise ValueError("a kind has no colon and a name isn't empty")
    return hashlib.sha256(f"{kind.lower()}:{name.lower()}".encode()).hexdigest()


_RESULT = "source_doc_id string, part string, id string, kind string, body string, from_id string, to_id string, t_valid string, t_invalid string, confidence double, problem string"


def _rows(doc: str, result: dict) -> list[tuple]:
    names: dict[str, str] = {}
    out = []
    for e in result.get("entities") or []:
        eid = entity_id(e["type"], e["name"])
        for alias in [e["name"], *(e.get("aliases") or [])]:
            names.setdefault(alias.lower(), eid)
        out.append((doc, "node", eid, e["type"], e["name"], None, None, None, None, None, None))
    for r in result.get("edges") or []:
        a, b = names.get(str(r.get("from_entity")).lower()), names.get(str(r.get("to_entity")).lower())
        c = r.get("confidence")
        problem = "unknown endpoint" if a is None or b is None else "confidence" if c is not None and not (isinstance(c, (int, float)) and math.isfinite(c) and 0 <= c <= 1) else None
        times = [r.get("t_valid"), r.get("t_invalid")]
        if any(t is not None and not isinstance(t, str) for t in times):
            problem, times = "time is no text", [None, None]
        out.append((doc, "edge", None, r["relation"], r.get("body"), a, b, *times, None if problem == "confidence" else c, problem))
    return out


def extract(documents: DataFrame, command: list[str], timeout: float = 60.0) -> DataFrame:
    """Staged rows of ``documents`` (source_doc_id, body) from the provider; a result must echo its request's id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if batch.empty:
                continue
            asked = [json.dumps({"documents": [{"source_doc_id": d, "body": b}]}) for d, b in zip(batch["source_doc_id"], batch["body"])]
            try:
                done = subprocess.run(command, input="\n".join(asked) + "\n", capture_output=True, text=True, timeout=timeout)
            except subprocess.TimeoutExpired as e:
                raise ExtractionFailed(f"no answer within {timeout} s") from e
            lines = done.stdout.splitlines()
            if done.returncode or len(lines) != len(asked):
                raise ExtractionFailed(f"exit {done.returncode}, {len(lines)} results for {len(asked)} documents: {done.stderr[-300:]}")
            out = []
            for doc, line in zip(batch["source_doc_id"], lines):
                result = json.loads(line)
                if result.get("source_doc_id") != doc:
                    raise ExtractionFailed(f"asked for {doc!r}, answered for {result.get('source_doc_id')!r}")
                out += _rows(doc, result)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _RESULT.split(", ")])

    return documents.select("source_doc_id", "body").mapInPandas(run, _RESULT)


def staged_nodes(staged: DataFrame) -> DataFrame:
    """One node per entity; the first document by id names it."""
    return staged.filter("part = 'node'").groupBy(F.col("id").alias("logical_id")).agg(F.min_by(F.struct("kind", "body", F.col("source_doc_id").alias("source_id")), F.struct("source_doc_id", "body")).alias("n")).select("logical_id", "n.*")


def staged_edges(staged: DataFrame) -> DataFrame:
    """Accepted edges, one per (from_id, to_id, kind), the first of a batch; a malformed time rejects its batch."""
    edges = staged.filter("part = 'edge'")
    wrong = edges.filter(F.col("problem").isNotNull() | malformed(F.col("t_valid")) | malformed(F.col("t_invalid"))).limit(1).collect()
    if wrong:
        raise ExtractionFailed(f"edge of {wrong[0].source_doc_id!r}: {wrong[0].problem or 'malformed time'}")
    timed = edges.select("from_id", "to_id", "kind", "body", F.col("source_doc_id").alias("source_id"), epoch(F.col("t_valid")).alias("t_valid"), epoch(F.col("t_invalid")).alias("t_invalid"), "confidence")
    return timed.groupBy("from_id", "to_id", "kind").agg(F.min_by(F.struct("body", "source_id", "t_valid", "t_invalid", "confidence"), F.struct("source_id", "body")).alias("e")).select("from_id", "to_id", "kind", "e.*")


def merge_facts(edges: DataFrame, incoming: DataFrame, cursor: int) -> DataFrame:
    """Edges after facts arrive: one current fact per (from_id, to_id, kind); the former is superseded, not doubled."""
    key = ["from_id", "to_id", "kind"]
    arrived = incoming.select(*key).distinct().withColumn("__new", F.lit(True))
    old = edges.join(arrived, key, "left").withColumn("superseded_at", F.when(F.col("superseded_at").isNull() & F.col("__new").isNotNull(), F.lit(cursor)).otherwise(F.col("superseded_at"))).drop("__new")
    return old.unionByName(incoming.withColumn("write_cursor", F.lit(cursor).cast("long")), allowMissingColumns=True)


def consolidate_by_recency(edges: DataFrame, subject: str = "from_id", relation: str = "kind") -> DataFrame:
    """(edge columns, verdict, new_t_invalid): of competing current edges of a (subject, relation) the latest stays.

    The others end when the next begins; a missing t_valid is the oldest; of equals the first presented (lowest
    cursor) is later.  Bodies are never rewritten.
    """
    rows = edges.filter(F.col("superseded_at").isNull()).withColumn("__old", -F.col("write_cursor"))
    judged = following(rows, [subject, relation], ["t_valid", "__old"], ["t_valid", "write_cursor"])
    last = F.col("next_write_cursor").isNull()
    end = F.when(last, F.col("t_invalid")).otherwise(F.coalesce("next_t_valid", "t_valid"))
    return judged.withColumn("verdict", F.when(last, "keep").otherwise("invalidate")).withColumn("new_t_invalid", end).drop("__old", "next_t_valid", "next_write_cursor")
