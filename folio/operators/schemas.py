"""JSON Schemas as rows, and their documentation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from folio.operators import reports


_JSON = {S.StringType: {"type": "string"}, S.BooleanType: {"type": "boolean"}, S.BinaryType: {"type": "string", "contentEncoding": "base64"}, S.DateType: {"type": "string", "format": "date"}, S.TimestampType: {"type": "string", "format": "date-time"}, S.TimestampNTZType: {"type": "string", "format": "date-time"}}


def json_schema(kind: S.DataType, title: str | None = None) -> dict:
    """The JSON Schema of a type: of a table's rows, if it is df.schema; columns that may not be null are required."""
    if isinstance(kind, S.StructType):
        out = {"type": "object", "properties": {f.name: json_schema(f.dataType) | ({"description": f.metadata["comment"]} if "comment" in f.metadata else {}) for f in kind.fields}}
        required = [f.name for f in kind.fields if not f.nullable]
        return ({"title": title} if title else {}) | out | ({"required": required} if required else {})
    if isinstance(kind, S.ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    if isinstance(kind, S.MapType):
        return {"type": "object", "additionalProperties": json_schema(kind.valueType)}
    if isinstance(kind, S.IntegralType):
        return {"type": "integer"}
    return dict(_JSON.get(type(kind), {"type": "number"} if isinstance(kind, S.NumericType) else {}))


def _walk(name: str, node: dict, defs: dict, seen: tuple[str, ...]) -> Iterator[tuple]:
    for prop, spec in sorted((node.get("properties") or {}).items()):
        ref = spec.get("$ref") or (spec.get("items") or {}).get("$ref")
        target = ref.rsplit("/", 1)[-1] if ref else None
        kind = spec.get("type") or ("object" if target else "any")
        kind = kind[0] if isinstance(kind, list) else kind
        yield (name, prop, kind, target, spec.get("description"), prop in (node.get("required") or []))
        inner = defs.get(target) if target else spec if kind == "object" else spec.get("items")
        if isinstance(inner, dict) and inner.get("properties") and (target or prop) not in seen:
            yield from _walk(target or prop, inner, defs, (*seen, target or prop))


def properties(schemas: DataFrame, key: str, body: str) -> DataFrame:
    """(key, parent, name, kind, target, description, required) of all properties, references followed once."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, text in zip(frame["key"], frame["body"], strict=True):
                top = json.loads(text) if text else {}
                defs = top.get("definitions") or top.get("$defs") or top.get("schemas") or {}
                root = top.get("title") or (top.get("$ref") or "root").rsplit("/", 1)[-1]
                start = defs.get(root, top) if "$ref" in top else top
                rows += [(k, *r) for r in dict.fromkeys(_walk(root, start, defs, (root,)))]
            yield pd.DataFrame(rows, columns=["key", "parent", "name", "kind", "target", "description", "required"])

    kind = dict(schemas.dtypes)[key]
    return schemas.select(F.col(key).alias("key"), F.col(body).alias("body")).mapInPandas(run, f"key {kind}, parent string, name string, kind string, target string, description string, required boolean").withColumnRenamed("key", key)


def documentation(props: DataFrame, key: str) -> DataFrame:
    """(key, document): a table for each object, values first, then objects, then lists, each by name."""
    order = F.when(F.col("kind") == "object", 1).when(F.col("kind") == "array", 2).otherwise(0)
    line = F.concat(F.lit("|"), "name", F.when(F.col("required"), "*").otherwise(""), F.lit("|"), F.coalesce("target", "kind"), F.lit("|"), F.coalesce("description", F.lit("-")))
    tables = reports.joined(props, [key, "parent"], line, [order, "name"], "\n", "rows")
    return reports.joined(tables, [key], F.concat(F.lit("== "), "parent", F.lit('\n\n[opts="header"]\n|===\n|Name|Type|Description\n'), "rows", F.lit("\n|===")), ["parent"], "\n\n", "document")
