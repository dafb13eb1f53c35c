"""Privacy-safe extracts (X-1...X-3) and their writers (SNK-2, SNK-3)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Forbidden column names (exact match on the lower-cased name)
# and the whole-value label replacements applied to every string column.
FORBIDDEN_COLUMNS = ("user_pseudo_id", "user_id", "transaction_id", "email", "phone", "ip_address",
                     "credential", "token", "key")
LABEL_MAP = {
    "(none)": "Direct",
    "(data deleted)": "Unknown",
    "<Other>": "Other",
    "(not set)": "Unknown",
}
REPORT_DATE_FORMATS = ("yyyy-MM-dd", "yyyyMMdd")


def drop_forbidden(df: DataFrame, forbidden=FORBIDDEN_COLUMNS) -> DataFrame:
    """X-1."""
    bad = [c for c in df.columns if c.lower() in set(forbidden)]
    return df.drop(*bad)


def clean_labels(df: DataFrame, mapping=None) -> DataFrame:
    """X-2: whole-value replacement in all string columns."""
    mapping = LABEL_MAP if mapping is None else mapping
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.replace(dict(mapping), subset=cols) if cols else df


def normalize_dates(df: DataFrame) -> DataFrame:
    """X-3: columns named ``..._date`` that hold text (yyyy-MM-dd or yyyyMMdd) or timestamps become DATE.

    Text in neither format becomes NULL. Other columns stay as they are.
    """
    def as_date(name: str, kind: T.DataType):
        if not name.endswith("_date"):
            return F.col(name)
        if isinstance(kind, T.StringType):
            return F.coalesce(*[F.try_to_timestamp(F.col(name), F.lit(f)).cast("date") for f in REPORT_DATE_FORMATS]).alias(name)
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.to_date(F.col(name)).alias(name)
        return F.col(name)

    return df.select(*[as_date(f.name, f.dataType) for f in df.schema.fields])


def safe_extract(df: DataFrame) -> DataFrame:
    return normalize_dates(clean_labels(drop_forbidden(df)))


def write_extracts(spark: SparkSession, marts: dict[str, DataFrame], out_dir: str,
                   source_dataset: str = "", disclosure: str = "") -> DataFrame:
    """SNK-2 + SNK-3: one Parquet folder per mart, plus a metadata record.

    Each mart is written by the tasks that make it (the per-user and per-item marts grow with the
    data). ``disclosure`` is the caller's statement about the data. Errors propagate. Returns the
    metadata as a one-row DataFrame.
    """
    for name, df in marts.items():
        safe_extract(df).write.mode("overwrite").parquet(f"{out_dir.rstrip('/')}/{name}")
    meta = spark.createDataFrame(
        [(_dt.datetime.now(_dt.timezone.utc).isoformat(), source_dataset, disclosure, list(marts))],
        "export_timestamp_utc string, source_dataset string, dataset_disclosure string, "
        "tables_exported array<string>")
    meta.coalesce(1).write.mode("overwrite").json(f"{out_dir.rstrip('/')}/metadata")
    return meta
