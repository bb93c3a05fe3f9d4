"""Schemas of the canonical tables and their versions (1.1-1.3, M16)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import InvalidArgument, WriteRejected

NODE = "write_cursor long, logical_id string, kind string, body string, source_id string, state string, reason string, valid_from long, valid_until long, superseded_at long, row_kind string, importance double, created_at long, status string"
EDGE = "write_cursor long, logical_id string, kind string, from_id string, to_id string, source_id string, body string, t_valid long, t_invalid long, confidence double, extractor_model_id string, temporal_fallback int, superseded_at long"
LOG = "id long, collection_name string, record_key string, op_kind string, payload_json string, schema_id string, write_cursor long"
STATE = "collection_name string, record_key string, payload_json string, schema_id string, write_cursor long"
ATTRIBUTE = "write_cursor long, attr_name string, attr_value string"
VECTOR = "write_cursor long, embedding array<float>, source_type string, kind string, created_at long, status string, centred array<float>, bits array<long>"
END = "write_cursor long, superseded_at long"
PUBLIC = {"nodes": NODE, "edges": EDGE, "log": LOG, "state": STATE, "attributes": ATTRIBUTE, "vectors": VECTOR}
ROW_KINDS = ("leaf", "coverage", "graph")
#: Where the ends of superseded versions are noted.
ENDS = {"nodes": "node_ends", "edges": "edge_ends"}
TABLES = PUBLIC | dict.fromkeys(ENDS.values(), END)

#: Versions of the layout, oldest first: (version, table, column and type added).  Steps are contiguous and only forward.
VERSIONS: list[tuple[int, str, str]] = [(1, "nodes", "write_cursor long"), (2, "nodes", "row_kind string"), (3, "nodes", "importance double"), (4, "edges", "temporal_fallback int"), (5, "nodes", "status string")]
VERSION = VERSIONS[-1][0]


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def migrate(df: DataFrame, table: str, version: int) -> DataFrame:
    """A table of an older version with the columns that later ones added; a newer version is refused."""
    if version > VERSION:
        raise InvalidArgument(f"version {version} is newer than {VERSION}")
    have = set(df.columns)
    out = df
    for _, t, column in VERSIONS:
        name, kind = column.split()
        if t == table and name not in have:
            out = out.withColumn(name, F.lit(None).cast(kind))
    return out


def fitted(rows: DataFrame, table: str) -> DataFrame:
    """Rows in the table's columns and types, missing ones null; unknown columns are refused."""
    kinds = [c.split(" ", 1) for c in re.split(r",\s*(?![^<]*>)", TABLES[table])]
    if unknown := set(rows.columns) - {n for n, _ in kinds}:
        raise WriteRejected(f"no such columns: {sorted(unknown)}")
    return rows.select(*[(F.col(n) if n in rows.columns else F.lit(None)).cast(k).alias(n) for n, k in kinds])


def payload_problems(payload: str, schema: dict) -> list[str]:
    """Where a JSON payload breaks a schema: type, required, properties, items, enum, minimum, maximum, pattern."""
    try:
        value = json.loads(payload)
    except ValueError:
        return ["not JSON"]
    return list(_problems(value, schema, "$"))


def check_schema(schema: dict) -> dict:
    """The schema, if it refers to nothing outside itself."""
    if '"$ref"' in json.dumps(schema):
        raise InvalidArgument("a schema can't refer to another document")
    return schema


_TYPES = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None)}


def _problems(value, schema: dict, at: str):
    kind = schema.get("type")
    number = isinstance(value, (int, float)) and not isinstance(value, bool)
    if kind in ("number", "integer"):
        if not number or (kind == "integer" and value != int(value)):
            yield f"{at}: no {kind}"
            return
    elif kind is not None and not isinstance(value, _TYPES[kind]):
        yield f"{at}: no {kind}"
        return
    if "enum" in schema and value not in schema["enum"]:
        yield f"{at}: not allowed"
    if number and "minimum" in schema and value < schema["minimum"]:
        yield f"{at}: below {schema['minimum']}"
    if number and "maximum" in schema and value > schema["maximum"]:
        yield f"{at}: above {schema['maximum']}"
    if isinstance(value, str) and "pattern" in schema and not re.search(schema["pattern"], value):
        yield f"{at}: doesn't match {schema['pattern']}"
    if isinstance(value, dict):
        yield from (f"{at}.{k}: missing" for k in schema.get("required", []) if k not in value)
        for k, s in schema.get("properties", {}).items():
            if k in value:
                yield from _problems(value[k], s, f"{at}.{k}")
    if isinstance(value, list) and "items" in schema:
        for i, v in enumerate(value):
            yield from _problems(v, schema["items"], f"{at}[{i}]")
