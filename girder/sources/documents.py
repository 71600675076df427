"""JSON documents at the edge: baselines, ledgers, manifests, snapshots."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from girder.schema import BASELINE, LEDGER


class Refused(ValueError):
    """A document that must not be read as something else."""


def read_baseline(spark: SparkSession, path: str) -> DataFrame:
    """(entry); a malformed baseline reads as empty."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.explode(F.from_json("value", BASELINE)["entries"]).alias("entry")).filter("entry is not null").distinct()


def baseline_document(entries: list[str]) -> str:
    return json.dumps({"version": 1, "entries": sorted(set(entries))}, indent=2, ensure_ascii=False) + "\n"


def read_ledgers(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sectors, holdouts, concessions) of ledger documents named <objective>.json; a malformed one is refused."""
    raw = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("objective"), "value")
    known = F.array(*map(F.lit, ("version", "kind", "created", "sectors", "concessions", "direction")))
    bad = raw.filter(F.json_object_keys("value").isNull() | (F.size(F.array_except(F.json_object_keys("value"), known)) > 0)).select("objective").limit(5).collect()
    if bad:
        raise Refused("unreadable ledgers: " + ", ".join(r[0] for r in bad))
    rows = raw.select("objective", F.from_json("value", LEDGER, {"mode": "FAILFAST"}).alias("d"))
    each = rows.select("objective", F.explode("d.sectors").alias("sector", "s"))
    sectors = each.select("objective", "sector", "s.entered", "s.initial", "s.cleared", "s.closed", F.col("s.lastCleared").alias("last_cleared"))
    holdouts = each.select("objective", "sector", F.posexplode("s.holdouts").alias("ord", "entry"))
    given = rows.select("objective", F.explode("d.concessions").alias("c")).select("objective", "c.sector", "c.at", "c.by", F.coalesce("c.delta", F.col("c.to") - F.col("c.from")).alias("delta"), "c.reason", "c.holdouts")
    return sectors, holdouts, given


def canonical_digest(value: object) -> str:
    """FNV-1a over JSON with sorted keys."""
    h = 0x811C9DC5
    data = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode("utf-16-le")
    for i in range(0, len(data), 2):
        h = ((h ^ (data[i] | data[i + 1] << 8)) * 0x01000193) & 0xFFFFFFFF
    return f"{h:08x}"


def manifest_hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# -- the conformance snapshot ------------------------------------------------------------------------------------------


def _rows(**fields: DataType) -> ArrayType:
    return ArrayType(StructType([StructField(k, v) for k, v in fields.items()]))


#: The shape of a snapshot: its JSON Schema and its decoder both come from here.
SNAPSHOT = StructType(
    [
        StructField("version", IntegerType()),
        StructField("ok", BooleanType()),
        StructField("coverage", _rows(family=StringType(), covered=LongType(), total=LongType(), share=DoubleType())),
        StructField("counts", _rows(measure=StringType(), value=LongType())),
        StructField("violations", _rows(kind=StringType(), n=LongType())),
        StructField("heights", _rows(height=IntegerType(), n=LongType())),
        StructField("cycles", _rows(comp=StringType(), size=IntegerType())),
    ]
)
JSON_TYPES = {StringType: "string", IntegerType: "integer", LongType: "integer", DoubleType: "number", BooleanType: "boolean"}


def json_schema(kind: DataType) -> dict:
    """JSON Schema of a type; objects admit no other keys."""
    if isinstance(kind, StructType):
        return {"type": "object", "properties": {f.name: json_schema(f.dataType) for f in kind.fields}, "required": kind.names, "additionalProperties": False}
    if isinstance(kind, ArrayType):
        return {"type": "array", "items": json_schema(kind.elementType)}
    return {"type": JSON_TYPES[type(kind)]}


def snapshot_schema() -> dict:
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Conformance snapshot", **json_schema(SNAPSHOT)}


def misfits(value: object, kind: DataType, at: str = "$") -> list[str]:
    """Where a JSON value is not of the type: all places, unknown and missing keys included."""
    if isinstance(kind, StructType):
        if not isinstance(value, dict):
            return [f"{at} is no object"]
        odd = [f"{at}.{k} is unknown" for k in sorted(set(value) - set(kind.names))] + [f"{at}.{k} is missing" for k in kind.names if k not in value]
        return odd + [x for f in kind.fields if f.name in value for x in misfits(value[f.name], f.dataType, f"{at}.{f.name}")]
    if isinstance(kind, ArrayType):
        return [x for i, v in enumerate(value) for x in misfits(v, kind.elementType, f"{at}[{i}]")] if isinstance(value, list) else [f"{at} is no list"]
    wanted = {"string": str, "boolean": bool, "integer": int, "number": (int, float)}[JSON_TYPES[type(kind)]]
    fits = isinstance(value, wanted) and (wanted is bool or not isinstance(value, bool))
    return [] if fits else [f"{at} is no {JSON_TYPES[type(kind)]}"]


def decode_snapshot(text: str) -> dict:
    """A snapshot that some run wrote; one that is not wholly of the shape is refused, with every reason."""
    try:
        value = json.loads(text)
    except ValueError as e:
        raise Refused(f"the snapshot is no JSON: {e}") from None
    if reasons := misfits(value, SNAPSHOT):
        raise Refused(*reasons)
    return value
