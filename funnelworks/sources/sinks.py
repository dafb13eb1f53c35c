"""Sinks (SNK-1, SNK-4): materialize a model as a view or a Parquet table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def as_view(df: DataFrame, name: str) -> DataFrame:
    """SNK-1, view materialization: a lazy temp view (recomputed by each reader)."""
    df.createOrReplaceTempView(name)
    return df


def as_table(df: DataFrame, path: str, partition_by: list[str] | None = None,
             mode: str = "overwrite") -> DataFrame:
    """SNK-1, table materialization: full refresh of a Parquet table, then read back.

    Reading the written files cuts the lineage: later models start from
    stored data, which survives lost executors (unlike a cache).
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)
    spark: SparkSession = df.sparkSession
    # the schema is known: no footer-reading inference job on read-back
    return spark.read.schema(df.schema).parquet(path)


def write_experiment_tables(summary: DataFrame, guardrails: DataFrame, out_dir: str,
                            fmt: str = "parquet") -> None:
    """SNK-4: experiment summary and guardrail tables (a few rows per experiment: one small file each)."""
    for name, df in (("experiment_summary", summary), ("guardrails_by_variant", guardrails)):
        w = df.coalesce(1).write.mode("overwrite")
        path = f"{out_dir.rstrip('/')}/{name}"
        if fmt == "csv":
            w.option("header", True).csv(path)
        else:
            w.parquet(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared checkpoint folder and read it back.

    One job (``checkpoint()`` computes the plan twice unless it is cached
    first), the result survives lost executors, and the lineage is cut.
    """
    import uuid

    from funnelworks.session import checkpoint_dir
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove an intermediate table that no one reads any more."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(jpath, True)
