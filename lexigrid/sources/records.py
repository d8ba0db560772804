"""JSON lines, tab-separated manifests, and record files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """Objects of a fixed schema, one a line; blank lines are skipped, anything else fails."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


class RecordError(ValueError):
    """A line that is no object of the schema; says which one."""


def check_jsonl(spark: SparkSession, path: str) -> None:
    """Raise RecordError for the first line of a file that is neither blank nor a JSON object."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n")).alias("at", "line"))
    text = F.trim(F.regexp_replace("line", "\r$", ""))
    bad = lines.where((text != "") & (F.json_object_keys(text).isNull())).orderBy("file", "at").limit(1).collect()
    if bad:
        raise RecordError(f"{bad[0].file}, line {bad[0]['at'] + 1}: {bad[0].line[:80]!r} is no object")


def read_tsv(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """A manifest with a header line; all columns are strings and must not be empty."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).option("sep", "\t").option("header", True).option("enforceSchema", False).csv(path)


def lean(df: DataFrame) -> DataFrame:
    """df with empty strings and arrays as nulls, which JSON writers leave out."""
    made = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType):
            c = F.when(F.size(c) > 0, c)
        elif isinstance(f.dataType, T.StringType):
            c = F.when(c != "", c)
        made.append(c.alias(f.name))
    return df.select(*made)


def envelope(kind: str, locale: str, source_locale: str, version: int = 11) -> dict[str, Column]:
    return {"schema_version": F.lit(version), "locale": F.lit(locale), "source_locale": F.lit(source_locale), "record_kind": F.lit(kind)}


def write_records(df: DataFrame, path: str, kind: str, locale: str, source_locale: str) -> None:
    """Record lines {schema_version, locale, source_locale, record_kind, record} in as many
    files as there are partitions; Spark's commit protocol leaves no partial files."""
    head = [c.alias(n) for n, c in envelope(kind, locale, source_locale).items()]
    row = lean(df)
    row.select(*head, F.struct(*row.columns).alias("record")).write.mode("overwrite").option("ignoreNullFields", True).json(path)
