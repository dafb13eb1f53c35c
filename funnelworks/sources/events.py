"""Event scans and mart loading (SRC-1, SRC-3, SRC-4, SRC-5, SRC-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.sources.schema import EXPERIMENT_UNIT, RAW_EVENT

# The range of the public sample, for callers who want it; scans read all dates unless told otherwise.
SAMPLE_START = "20210101"
SAMPLE_END = "20210131"


def date_range(df: DataFrame, start: str | None, end: str | None, col: str = "event_date") -> DataFrame:
    """Inclusive ``start <= col <= end`` on yyyyMMdd text (FLT-1); None = open end."""
    if start is not None:
        df = df.where(F.col(col) >= F.lit(start))
    if end is not None:
        df = df.where(F.col(col) <= F.lit(end))
    return df


def scan_events(spark: SparkSession, path: str, start: str | None = None,
                end: str | None = None) -> DataFrame:
    """SRC-1/SRC-2: raw events stored as Parquet partitioned by ``event_date``.

    The declared schema keeps ``event_date`` a string, and the range filter
    on the partition column becomes a ``PartitionFilters`` entry: unread
    dates are never listed or opened.
    """
    df = spark.read.schema(RAW_EVENT).parquet(path)
    return date_range(df, start, end)


def scan_sharded_events(spark: SparkSession, base: str, start: str | None = None,
                        end: str | None = None, prefix: str = "events_") -> DataFrame:
    """SRC-1 for date-sharded exports: one folder per day named ``<prefix>YYYYMMDD``.

    Shards outside the inclusive range are dropped while listing the base
    folder (file metadata only), so they are never opened; ``event_date``
    is taken from the shard name of each row's file (``_metadata.file_path``).
    """
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    paths = []
    for st in fs.listStatus(root):
        name = st.getPath().getName()
        suffix = name[len(prefix):]
        if not (st.isDirectory() and name.startswith(prefix) and len(suffix) == 8 and suffix.isdigit()):
            continue
        if (start is None or suffix >= start) and (end is None or suffix <= end):
            paths.append(st.getPath().toString())
    data_schema = T.StructType([f for f in RAW_EVENT.fields if f.name != "event_date"])
    if not paths:
        return spark.createDataFrame([], RAW_EVENT)
    df = spark.read.schema(data_schema).parquet(*sorted(paths))
    shard = F.regexp_extract(F.col("_metadata.file_path"), f"/{prefix}([0-9]{{8}})/", 1)
    return df.select(shard.alias("event_date"), *[f.name for f in data_schema.fields])


def read_experiment_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC-5: experiment unit CSV whose first line is a ``#`` disclaimer."""
    return (spark.read.option("header", True).option("comment", "#")
            .schema(EXPERIMENT_UNIT).csv(path))


def table_exists(spark: SparkSession, name: str, base: str | None = None) -> bool:
    """SRC-4: a catalog table, or a Parquet folder under ``base``."""
    if base is not None:
        path = f"{base.rstrip('/')}/{name}"
        jvm = spark.sparkContext._jvm
        jpath = jvm.org.apache.hadoop.fs.Path(path)
        fs = jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        return bool(fs.exists(jpath))
    return spark.catalog.tableExists(name)


def load_mart(spark: SparkSession, name: str, mode: str = "static", base: str | None = None) -> DataFrame:
    """SRC-3: a mart by name, from Parquet (``static``) or the catalog (``table``).

    An unknown mode or a missing mart raises: errors are not turned into
    empty frames.
    """
    mode = mode.lower()
    if mode == "static":
        if base is None:
            raise ValueError("static mode needs the base folder of the extracts")
        path = f"{base.rstrip('/')}/{name}"
        if not table_exists(spark, name, base):
            raise FileNotFoundError(f"missing extract {path}")
        return spark.read.parquet(path)
    if mode in ("table", "warehouse", "catalog"):
        return spark.table(name)
    raise ValueError(f"invalid data mode {mode!r}: use 'static' or 'table'")
