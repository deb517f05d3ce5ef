"""Table readers and writers: parquet tables, CSV files, append-only sinks, audit export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from riskloom.functions.clock import parse_wall_clock
from riskloom.operators.tables import within
from riskloom.schemas import AUDIT_ENTRIES, TRAINING_CSV


def read_table(spark: SparkSession, folder: str, name: str, schema: str | None = None) -> DataFrame:
    """The parquet table ``name`` below ``folder``; a ``schema`` spares the job that looks it up."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def read_transactions_csv(spark: SparkSession, path: str) -> DataFrame:
    """Training CSV with a header, by explicit schema, its ISO times parsed as wall-clock ``ts``."""
    rows = spark.read.schema(TRAINING_CSV).options(**CSV_OPTIONS).csv(path)
    return rows.withColumn("ts", parse_wall_clock(F.col("timestamp")))


# Full precision for times; a quote inside a value is doubled, so backslashes mean themselves.
TIME_FORMATS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"', **TIME_FORMATS}


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV files with a header, one per partition."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def append(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Insert rows into an append-only parquet table; rows already there are never touched."""
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def append_by_day(df: DataFrame, path: str, time: str = "created_at") -> None:
    """``append`` partitioned by day, so that time-bounded reads prune files."""
    append(df.withColumn("day", F.to_date(time)), path, ("day",))


def store_batch(df: DataFrame, path: str, batch_id: str, time: str | None = "created_at") -> None:
    """One batch of a table in folders ``batch_id=…/day=…`` (no days without a ``time``).

    Storing the batch again replaces all of it, days that have become empty included. Batch jobs and streams share this
    layout, so one reader reads both, and time-bounded reads open only their days.
    """
    if time is not None:
        df = df.withColumn("day", F.to_date(time))
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "static")
    if time is not None:
        writer = writer.partitionBy("day")
    writer.parquet(f"{path}/batch_id={batch_id}")


def read_store(spark: SparkSession, path: str, schema: str | StructType | None = None) -> DataFrame | None:
    """All batches of a table; None if there is none yet. With a ``schema`` a table of empty batches can be read as well."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        # The last is the second one for the folder of a stream's file sink.
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA", "_LEGACY_ERROR_TEMP_1134"):
            return None
        raise


def store_by_key(df: DataFrame, name: str, path: str, key: str, buckets: int = 64, spread: int = 8) -> DataFrame:
    """A table in ``buckets`` by ``key``, sorted by it within files: a reader of one key opens one bucket and skips most of it.

    Rows of one key are written by up to ``spread`` tasks, so that a frequent key is not one task's work.
    """
    part = F.pmod(F.xxhash64(*df.columns), F.lit(spread))
    rows = df.repartition(buckets, F.col(key), part)
    rows.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def batch_name(df: DataFrame, *columns: str) -> str:
    """A name for a batch of rows that only depends on these columns' values, in any order of rows."""
    row = df.agg(F.sum(F.xxhash64(*columns).cast("decimal(20,0)")).alias("sum"), F.count(F.lit(1)).alias("n")).first()
    return f"batch-{row['n']}-{int(row['sum'] or 0) % 2**64:016x}"


def replace_reference_sample(df: DataFrame, path: str, value: str = "value") -> None:
    """Replace the drift baseline by the numbers in ``df``."""
    df.select(F.col(value).cast("double").alias("value")).write.mode("overwrite").parquet(path)


def read_reference_sample(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value double").parquet(path)


def export_audit(df: DataFrame, path: str, start, end, fmt: str = "json") -> None:
    """Entries of an inclusive time range in chronological order, as JSON or CSV files."""
    if fmt not in ("json", "csv"):
        raise ValueError("fmt must be 'json' or 'csv'")
    rows = audit_between(df, start, end)
    if fmt == "csv":
        write_csv(rows, path)
    else:
        rows.write.options(**TIME_FORMATS).json(path)


def read_audit_export(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    """Entries of an export, in the audit table's types."""
    reader = spark.read.schema(AUDIT_ENTRIES)
    return reader.options(**CSV_OPTIONS).csv(path) if fmt == "csv" else reader.options(**TIME_FORMATS).json(path)


def audit_between(df: DataFrame, start, end) -> DataFrame:
    """Audit entries with ``start <= created_at <= end``, oldest first."""
    return within(df, start, end).orderBy("created_at", "sha256_checksum")
