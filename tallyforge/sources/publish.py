"""Results as documents: shape checks, publishing that never goes back, encoded history, configuration and parameters of a report."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass
from urllib.parse import parse_qs
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.order import coded, placed_within
from .scratch import stored

#: What a report may be asked for.
UNITS, METRICS, GROUPS = ("day", "week", "month"), ("credits", "tokens"), ("owner", "model", "owner_model", "account")


#: Versions of a document that stay, for readers that have begun; minutes after which an unchanged one is published again.
KEPT, HEARTBEAT = 3, 20


def has_shape(payload: Column) -> Column:
    """Whether a text is a JSON object with a number as generated_at and an object as summary."""
    doc = F.try_parse_json(payload)
    kind = lambda path: F.schema_of_variant(F.try_variant_get(doc, path, "variant"))
    number = kind("$.generated_at").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
    tests = (F.schema_of_variant(doc).startswith("OBJECT"), number, kind("$.summary").startswith("OBJECT"))
    return F.coalesce(tests[0] & tests[1] & tests[2], F.lit(False))


def _folder(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions of a document that are there, the newest last."""
    at, fs = _folder(spark, path)
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    return sorted(int(n) for n in names if n.isdigit())


def document(spark: SparkSession, path: str) -> DataFrame | None:
    """The newest version of a document, one row: value; None where there is none."""
    there = versions(spark, path)
    return spark.read.schema("value string").text(f"{path}/{there[-1]:020}", wholetext=True) if there else None


def published_at(spark: SparkSession, path: str) -> int | None:
    """The generated_at of a document; None where there is none."""
    there = versions(spark, path)
    return there[-1] if there else None


def _put(value: DataFrame, path: str, version: int) -> bool:
    """Write a version beside the others and give it its name by one rename. The newest name is the document, so no reader finds none, and a
    writer that is late cannot bring an older one back."""
    spark = value.sparkSession
    new = f"{path}/_new-{uuid4().hex}"
    value.select("value").coalesce(1).write.text(new)
    (source, fs), (target, _) = _folder(spark, new), _folder(spark, f"{path}/{version:020}")
    done = not fs.exists(target) and fs.rename(source, target)
    if not done:
        fs.delete(source, True)
    for old in versions(spark, path)[:-KEPT]:
        fs.delete(_folder(spark, f"{path}/{old:020}")[0], True)
    return done


def _generated_at() -> Column:
    return F.try_variant_get(F.try_parse_json("value"), "$.generated_at", "bigint")


def publish(value: DataFrame, path: str) -> bool:
    """Publish a document (one row: value, JSON text with generated_at) unless the one at the path is as new or newer, or it has not the shape."""
    row = value.select(has_shape(F.col("value")).alias("fine"), _generated_at().alias("at")).first()
    held = published_at(value.sparkSession, path)
    return bool(row and row.fine and (held is None or row.at > held)) and _put(value, path, row.at)


def _told(parts: list[str] | None) -> Column:
    """A hash of what a document says, whatever its time: of its summary, or of some parts of that."""
    doc = F.try_parse_json("value")
    each = [F.to_json(F.try_variant_get(doc, path, "variant")) for path in ([f"$.summary.{p}" for p in parts] if parts else ["$.summary"])]
    return F.sha2(F.concat_ws("|", *(F.coalesce(x, F.lit("-")) for x in each)), 256)


def publish_if_changed(value: DataFrame, path: str, parts: list[str] | None = None, heartbeat: int = HEARTBEAT) -> bool:
    """Like publish, but a document that says the same as the one at the path is published only `heartbeat` minutes after that: readers take an old one for a stopped service."""
    held = document(value.sparkSession, path)
    if held is not None:
        now, then = (d.select(_told(parts).alias("told"), _generated_at().alias("at")).first() for d in (value, held))
        if now is None or (now.told == then.told and (now.at or 0) - then.at < heartbeat * 60_000):
            return False
    return publish(value, path)


def update_status(spark: SparkSession, path: str, **fields) -> dict:
    """Merge fields into a small status document; what they do not name stays, so a failed run does not hide when the last one succeeded."""
    held = document(spark, path)
    status = (json.loads(held.first().value) if held is not None else {}) | fields
    _put(spark.createDataFrame([(json.dumps(status, sort_keys=True),)], "value string"), path, (published_at(spark, path) or 0) + 1)
    return status


def synchronised(spark: SparkSession, sources: list[str], path: str, status: str, now: int) -> bool:
    """Copy the snapshot of the first source that can be read and has the shape, unless it is older than the copy; True if the copy is new.

    sources: paths that Spark reads. Each is tried once in their order; the status tells which one served, or why none did.
    """
    errors = []
    for source in sources:
        try:
            value = spark.read.schema("value string").text(source, wholetext=True)
            row = value.select("value", has_shape(F.col("value")).alias("fine")).first()
        except AnalysisException as e:
            errors.append(f"{source}: {e.getCondition()}")
            continue
        if row is None or not row.fine:
            errors.append(f"{source}: no snapshot")
            continue
        new = publish(value, path)
        update_status(spark, status, checked_at=now, ok=True, source=source, error=None, **({"synced_at": now} if new else {}))
        return new
    update_status(spark, status, checked_at=now, ok=False, source=sources[0] if sources else None, error=" / ".join(errors)[:500])
    return False


def as_document(parts: dict[str, DataFrame], generated_at: int) -> DataFrame:
    """One row, value: a JSON object of named results (each a list of its rows) and generated_at. For results that a reader opens whole: summaries, reports."""
    spark = next(iter(parts.values())).sparkSession
    out = spark.range(1).select(F.lit(generated_at).alias("generated_at"))
    for name, rows in parts.items():
        listed = rows.agg(F.collect_list(F.struct(*rows.columns)).alias("list"))
        out = out.join(F.broadcast(listed.withColumnRenamed("list", name)))
    names = [F.struct(*parts).alias("summary")]
    return out.select(F.to_json(F.struct("generated_at", *names)).alias("value"))


def encoded(rows: DataFrame, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows with each dimension's value as its place among the sorted ones, from 0; (dim, code, value) of all values).

    The values of all dimensions are sorted together, by dimension and value, once; numbers, whose order is not that of their texts, each by themselves.
    """
    rows = stored(rows)
    texts = [d for d in dims if dict(rows.dtypes)[d] == "string"]
    held = None
    if texts:
        each = F.explode(F.array(*(F.struct(F.lit(d).alias("dim"), F.col(d).alias("value")) for d in texts))).alias("_v")
        held = stored(placed_within(rows.select(each).select("_v.dim", "_v.value").distinct(), "dim", [F.col("value").asc_nulls_first()], "code").select("dim", "code", "value"))
    out, lists = rows, [held] if texts else []
    for d in dims:
        if d in texts:
            own = held.filter(F.col("dim") == d).select(F.col("code").alias(f"_{d}"), F.col("value").alias(f"_value_{d}"))
            out = out.join(own, F.col(d).eqNullSafe(F.col(f"_value_{d}"))).drop(f"_value_{d}")
        else:
            out = coded(out, d, f"_{d}")
            lists.append(out.select(F.lit(d).alias("dim"), F.col(f"_{d}").alias("code"), F.col(d).cast("string").alias("value")).distinct())
    every = lists[0]
    for x in lists[1:]:
        every = every.unionByName(x)
    return out.select(*(F.col(f"_{d}").alias(d) for d in dims), *(c for c in rows.columns if c not in dims)), every


@dataclass(frozen=True)
class Parameters:
    first: str
    last: str
    by: str = "owner"
    unit: str = "day"
    metric: str = "credits"


def report_parameters(fragment: str, first_day: str, last_day: str) -> Parameters:
    """Parameters of a report from the fragment of an address (from, to, by, unit, metric); what is absent or wrong is the default, this month up to the last day."""
    asked = {k: v[-1] for k, v in parse_qs(fragment.partition("?")[2]).items()}
    one_of = lambda key, allowed: asked[key] if asked.get(key) in allowed else allowed[0]
    day = lambda key, other: asked[key] if re.fullmatch(r"\d{4}-\d{2}-\d{2}", asked.get(key, "")) else other
    a, z = sorted((day("from", max(first_day, last_day[:7] + "-01")), day("to", last_day)))
    return Parameters(a, z, one_of("by", GROUPS), one_of("unit", UNITS), one_of("metric", METRICS))


def read_config(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The tables of a configuration (rules, pins, rates, thresholds, overrides ...) from one JSON document: each a list of objects, with its
    place as pos; an absent one is empty."""
    whole = ", ".join(f"{name} array<struct<{fields}>>" for name, fields in schemas.items())
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", whole).alias("c"))
    return {name: doc.select(F.posexplode(f"c.{name}").alias("pos", "r")).select("pos", "r.*") for name in schemas}


def day_records(spark: SparkSession, path: str) -> DataFrame:
    """Records of another store by day, a JSON object a line (.jsonl or .jsonl.gz), with their order as (file, line)."""
    fields = "day string, provider string, account string, host string, session_id string, cwd string, model string, speed string, effort string, lc int, n long, i long, o long, cw long, cr long, cw1h long, cwu long"
    raw = spark.read.schema(fields).json(path)
    # Within a file, numbers go up with the lines.
    return raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"))
