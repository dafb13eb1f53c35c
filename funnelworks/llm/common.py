"""Helpers shared by the training-data operators: shared-folder tables, document input, ordered partitions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from funnelworks.session import checkpoint_dir

#: Documents per inner step of an Arrow batch, so the Python lists of a step stay small.
STEP = 256


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder path in the shared folder of the session (``spark.checkpoint.dir``)."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: str = "doc_id") -> F.Column:
    """crc32 of the id as text, modulo 4, is 2 (a null id: not held out)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def steps(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in slices of at most STEP rows."""
    for i in range(0, batch.num_rows, STEP):
        yield batch.slice(i, STEP)


def per_document(docs: DataFrame, columns: list[str], fn: Callable[[list], list], schema: str) -> DataFrame:
    """One output row per document: ``fn(texts)`` gives one tuple per text (null texts come as '').

    ``columns`` are passed through in front of the tuple's fields; ``schema`` names all of them.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for part in steps(batch):
                got = fn([t or "" for t in part.column(len(columns)).to_pylist()])
                out = out or arrow_schema
                cols = [part.column(i) for i in range(len(columns))]
                cols += [pa.array(c, out.field(len(columns) + k).type) for k, c in enumerate(zip(*got, strict=True))]
                yield pa.RecordBatch.from_arrays([c.cast(out.field(i).type) for i, c in enumerate(cols)], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow_schema = to_arrow_schema(StructType.fromDDL(schema))
    return docs.select(*columns, "text").mapInArrow(run, schema)


def split_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of the long column ``key`` that cut its rows into about equal ranges.

    Only the split points reach the driver, one per range. Range p holds the keys from split p-1
    (included) to split p (not included); null keys belong to the first range.
    """
    if parts < 2:
        return []
    cuts = [i / parts for i in range(1, parts)]
    got = df.select(F.percentile_approx(key, F.lit(cuts), F.lit(max(10_000, 20 * parts)))).first()[0]
    return sorted(set(got or []))


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def _mapped(df: DataFrame, column: str, kind, change: Callable[[], Callable]) -> DataFrame:
    """``df`` with the values of ``column``, other than null, changed by the function that ``change()`` makes in each task."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructField, StructType

    at = df.columns.index(column)
    schema = StructType([StructField(f.name, kind if k == at else f.dataType, True) for k, f in enumerate(df.schema)])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = change()
        for batch in batches:
            for part in steps(batch):
                new = [None if x is None else one(x) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(new, arrow.field(k).type) if k == at else c.cast(arrow.field(k).type)
                                                  for k, c in enumerate(part.columns)], schema=arrow)

    return df.mapInArrow(run, schema)


def _squeezer() -> Callable:
    import zstandard

    squeeze = zstandard.ZstdCompressor(level=1).compress
    return lambda text: squeeze(text.encode())


def _unpacker() -> Callable:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    return lambda data: unpack(data).decode()


def packed(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with the texts of ``column`` compressed, for a shuffle."""
    from pyspark.sql.types import BinaryType

    return _mapped(df, column, BinaryType(), _squeezer)


def unpacked(df: DataFrame, column: str = "text") -> DataFrame:
    """``packed`` undone."""
    from pyspark.sql.types import StringType

    return _mapped(df, column, StringType(), _unpacker)


def aside(docs: DataFrame, *keep: str) -> DataFrame:
    """``docs`` with its columns other than ``keep`` named by their places (_x0, _x1, ...), so that none clashes with a name of an
    operator's own; ``toDF`` gives their names back."""
    kept = {c.lower() for c in keep}
    return docs.toDF(*[c if c.lower() in kept else f"_x{k}" for k, c in enumerate(docs.columns)])


def join_texts(docs: DataFrame, narrow: DataFrame, id_col: str, pack: bool) -> DataFrame:
    """``docs`` left-joined to ``narrow`` (_id, _h, ...) on the id, null-safe, and the md5 of the text (null read as empty).

    One plan at every size: the texts cross the shuffle, with ``pack`` compressed, and stay so in the result (``unpacked``
    restores them); ``narrow`` is the side that is hashed in each task, and AQE splits rows that repeat very often.
    """
    own = docs.withColumn("_own_h", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    mine = F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_own_h") == F.col("_h"))
    return (packed(own) if pack else own).join(narrow.hint("shuffle_hash"), mine, "left").drop("_own_h")
