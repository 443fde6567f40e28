"""Reading event logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.frames import quoted
from ..schema import LogSchema


def read_event_log(
    spark: SparkSession, schema: LogSchema, path: str, format: str = "csv", parse_time: bool = True
) -> DataFrame:
    """Event log typed by role: numeric columns double, all others string, time parsed.

    CSV is ``;`` separated ISO-8859-1 with a header; lines with too many fields are
    dropped, short ones are kept with nulls. Rows without a case id are dropped.
    """
    if format == "csv":
        df = _read_csv(spark, path)
    else:
        df = spark.read.format(format).load(path)
    numeric = set(schema.numeric)
    picked = []
    for f in df.schema.fields:
        column = F.col(quoted(f.name))
        if f.name in numeric:
            picked.append(column.try_cast("double").alias(f.name))
        elif f.name == schema.ts:
            picked.append((column.try_cast("timestamp") if parse_time else column).alias(f.name))
        elif isinstance(f.dataType, T.StringType):
            picked.append(column)
        elif f.name in (*schema.categorical, schema.case, schema.label):
            picked.append(column.cast("string").alias(f.name))
        else:
            picked.append(column)
    return df.select(*picked).where(F.col(quoted(schema.case)).isNotNull())


def _read_csv(spark: SparkSession, path: str) -> DataFrame:
    options = {"sep": ";", "encoding": "ISO-8859-1", "header": "true"}
    names = spark.read.options(**options).csv(path).columns
    fields = [T.StructField(n, T.StringType()) for n in [*names, "_raw"]]
    reader = spark.read.options(**options, mode="PERMISSIVE", columnNameOfCorruptRecord="_raw")
    rows = reader.schema(T.StructType(fields)).csv(path)
    # All columns are strings, so the raw line is kept only where the field count is off.
    # Separators inside quotes do not end a field.
    bare = F.regexp_replace("_raw", r'"(?:[^"\\]|\\.)*"', "")
    too_long = F.size(F.split(bare, ";")) > len(names)
    return rows.where(F.col("_raw").isNull() | ~too_long).drop("_raw")
