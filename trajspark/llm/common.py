"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MARK_BITS = 26
WORD_GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns that operators read, so that extra columns never clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in ``body``.

    A plain column would be copied into each lambda that reads it and be computed again for every
    element; a lambda variable is bound once.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_GAP), "")


def text_hashes(text: Column) -> tuple[Column, Column]:
    """Two hashes that, beside the id, tell rows apart: ids may repeat or be null."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores before them as none of the columns needs."""
    taken = {c.lower() for c in df.columns}
    mark = "__"
    while any(f"{mark}{n}".lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names for checkpoints, which the whole cluster shares.

    Only a session that names none and runs on a single machine (tests) gets a temporary folder.
    """
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage, in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder as a table and read back, so that readers take only the columns they need."""
    folder = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def delete_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def with_mark(df: DataFrame, key: Column, known: DataFrame, known_key: Column, name: str) -> DataFrame:
    """``df`` with a boolean: false only if key is none of known's keys. Rows that it rules out need no shuffle.

    The keys are bits of a table of MARK_BITS bits whatever their number, made as bitmaps by the cluster and broadcast:
    8 MB at most. With very many keys it rules out less; a join must decide the rest.
    """
    place = lambda k: F.shiftrightunsigned(F.xxhash64(k), 64 - MARK_BITS) + 1  # noqa: E731  bitmaps count from 1
    bucket, bits = fresh(df, "bucket", "bits")
    own = place(known_key)
    maps = known.groupBy(F.bitmap_bucket_number(own).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(own)).alias(bits))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = df.withColumn(f"{bucket}_", F.bitmap_bucket_number(place(key))).join(F.broadcast(maps), F.col(bucket) == F.col(f"{bucket}_"), "left")
    here = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False)) & key.isNotNull()
    return marked.withColumn(name, here).drop(bucket, bits, f"{bucket}_")


def release_memory() -> None:
    """Gives a worker's free memory back to the machine at the end of a task; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)
