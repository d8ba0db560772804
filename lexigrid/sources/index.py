"""The fact index on storage: immutable generations behind a pointer.

A generation is a folder of Parquet tables named by the digest of its content; `current`
holds the name of the one in use. Readers open what the pointer names when they start, so a
new generation never changes under them, and writing one is all or nothing.
"""

from __future__ import annotations

import os
import time
from collections.abc import Mapping
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import SCHEMA_VERSION, TABLES, schema

POINTER = "current"


class IndexFormatError(ValueError):
    pass


def digest(df: DataFrame) -> str:
    """Order-independent digest of the rows: their number and the sum of row hashes."""
    mark = df.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")), F.lit(0))).first()
    return f"{mark[0]}:{mark[1]}"


LOCK, LOCK_SECONDS, POLL_SECONDS = ".lock", 30.0, 0.05


@contextmanager
def locked(spark: SparkSession, folder: str, wait: float = LOCK_SECONDS):
    """Only one writer of a folder at a time: a file that must not exist yet; waits for it."""
    fs, lock = _path(spark, f"{folder}/{LOCK}")
    until = time.monotonic() + wait
    while True:
        try:
            fs.create(lock, False).close()
            break
        except Py4JJavaError as problem:
            if "FileAlreadyExists" not in str(problem.java_exception):
                raise
            if time.monotonic() > until:
                raise IndexFormatError(f"another build holds {folder}/{LOCK}") from None
            time.sleep(POLL_SECONDS)
    try:
        yield
    finally:
        fs.delete(lock, False)


def index_path(given: str | None = None, variable: str = "LEXIGRID_INDEX", default: str = ".lexigrid/index") -> str:
    """Where the index is: the given path, else that of the environment, else the default."""
    return given or os.environ.get(variable) or default


def publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str) -> str:
    """Write the tables as a generation and point to it; an identical one is reused. A build
    that fails leaves no stage behind and the pointer as it was."""
    with locked(spark, folder):
        stage = f"{folder}/stage-{time.time_ns():x}"
        try:
            return _publish(spark, tables, folder, stage)
        finally:
            fs, left = _path(spark, stage)
            fs.delete(left, True)


def _publish(spark: SparkSession, tables: Mapping[str, DataFrame], folder: str, stage: str) -> str:
    unknown = set(tables) - set(TABLES)
    if unknown or "documents" not in tables:
        raise IndexFormatError(f"unknown tables {sorted(unknown)}" if unknown else "the table documents is missing")
    for name, df in tables.items():
        shaped = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema(name).fields])
        shaped.write.parquet(f"{stage}/{name}")
    written = {name: spark.read.schema(schema(name)).parquet(f"{stage}/{name}") for name in tables}
    if written["documents"].isEmpty():
        raise IndexFormatError("the index has no documents")
    marks = {name: digest(df) for name, df in sorted(written.items())}
    named = spark.range(1).select(F.sha2(F.lit(repr((SCHEMA_VERSION, marks))), 256)).first()[0]
    rows = [("schema_version", str(SCHEMA_VERSION)), ("built_at", str(int(time.time()))), ("generation", named), *((f"digest.{n}", m) for n, m in marks.items())]
    spark.createDataFrame(rows, schema("meta")).coalesce(1).write.mode("overwrite").parquet(f"{stage}/meta")
    fs, source = _path(spark, stage)
    _, target = _path(spark, f"{folder}/generation={named}")
    if not fs.exists(target) and not fs.rename(source, target):
        raise IndexFormatError(f"cannot publish {named}")
    # the pointer is written beside and renamed over, so that no reader sees half of it
    _, beside = _path(spark, f"{folder}/.{POINTER}-{time.time_ns():x}")
    out = fs.create(beside, True)
    out.write(bytearray(named.encode()))
    out.close()
    _, pointer = _path(spark, f"{folder}/{POINTER}")
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    options = gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    # one step where the store can replace a file by a rename; a failure is raised
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(beside, pointer, options)
    return named


def current(spark: SparkSession, folder: str) -> str:
    rows = spark.read.text(f"{folder}/{POINTER}").collect()
    if len(rows) != 1:
        raise IndexFormatError("the pointer names no generation")
    return rows[0][0].strip()


def open_index(spark: SparkSession, folder: str, generation: str | None = None, verify: bool = False) -> dict[str, DataFrame]:
    """Tables of a generation (the current one by default); the schema version must match,
    and with `verify` so must the digest of every table."""
    named = generation or current(spark, folder)
    at = f"{folder}/generation={named}"
    meta = {r.key: r.value for r in spark.read.schema(schema("meta")).parquet(f"{at}/meta").collect()}
    if meta.get("schema_version") != str(SCHEMA_VERSION):
        raise IndexFormatError(f"schema version {meta.get('schema_version')}, {SCHEMA_VERSION} is needed; build the index again")
    names = [k.removeprefix("digest.") for k in meta if k.startswith("digest.")]
    found = {n: spark.read.schema(schema(n)).parquet(f"{at}/{n}") for n in names}
    if verify:
        for n, df in found.items():
            if digest(df) != meta[f"digest.{n}"]:
                raise IndexFormatError(f"table {n} differs from what was published")
    return found | {"meta": spark.read.schema(schema("meta")).parquet(f"{at}/meta")}


def family_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(family, n) of the tables of an opened index; documents by kind as documents/kind."""
    found = tables["documents"].groupBy(F.concat(F.lit("documents/"), "kind").alias("family")).agg(F.count("*").alias("n"))
    for name, df in sorted(tables.items()):
        if name != "meta":
            found = found.unionByName(df.agg(F.count("*").alias("n")).select(F.lit(name).alias("family"), "n"))
    return found


def stored_bytes(spark: SparkSession, folder: str, generation: str | None = None) -> dict[str, int]:
    """Bytes on storage of each table of a generation."""
    named = generation or current(spark, folder)
    found = {}
    for name in TABLES:
        fs, at = _path(spark, f"{folder}/generation={named}/{name}")
        if fs.exists(at):
            found[name] = fs.getContentSummary(at).getLength()
    return found


def metadata(spark: SparkSession, folder: str) -> dict[str, str]:
    at = f"{folder}/generation={current(spark, folder)}/meta"
    found = {r.key: r.value for r in spark.read.schema(schema("meta")).parquet(at).collect()}
    for key in ("schema_version", "built_at", "generation"):
        if key not in found:
            raise IndexFormatError(f"metadata key {key} is missing")
    if not found["built_at"].isdigit():
        raise IndexFormatError("built_at is no number")
    return found


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    made = jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made
