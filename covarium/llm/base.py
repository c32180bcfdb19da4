"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: Tables of at most so many narrow rows (some 16 bytes each) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 1_000_000
_FOLDERS: dict[str, int] = {}

#: Keys of more rows than this are hot.
HOT_ROWS = 1000
#: Rows with texts or lists are broadcast if those have at most so many bytes together, too.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, payload: Column | None = None, rows: int = BROADCAST_ROWS) -> bool:
    """Whether ``df``, a written table, may be broadcast; ``payload`` is the size in bytes of a row's texts and lists."""
    n, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.lit(0) if payload is None else payload), F.lit(0))).first()
    return n <= rows and size <= BROADCAST_BYTES


#: A written table of known size gets a file for so many narrow rows.
FILE_ROWS = 20_000


#: Hadoop's local file system without checksums; other file systems are not affected.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}

#: Whole texts go to Python at most so many at a time: the executor and its workers hold each batch several times over, and keep the memory.
TEXT_ROWS = 1000
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def few(df: DataFrame, rows: int, each: int = FILE_ROWS) -> DataFrame:
    """``df``, of about ``rows`` rows, in no more partitions than that takes.

    A small file costs more than its rows.  For what a shuffle has dealt: a scan would run in few tasks.
    """
    return df.coalesce(1 + rows // each)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        found = tempfile.mkdtemp(prefix="covarium-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _folder(spark: SparkSession) -> str:
    """A folder of this application in the shared one, which goes when the driver's process ends."""
    path = f"{shared_dir(spark)}/covarium-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS[path] = os.getpid()
        atexit.register(release, spark, path)
    return path


def release(spark: SparkSession, path: str) -> None:
    """Delete the tables written to ``path``; a no-op in a forked process and where the JVM is gone."""
    if _FOLDERS.pop(path, None) != os.getpid():
        return
    try:
        jvm = spark.sparkContext._jvm
        place = jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(place, True)
    except (Py4JError, OSError, AttributeError):
        pass


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here, and a lost executor loses nothing.

    Where that is a local folder, files are written without checksum files and without the two
    processes (chmod) a file, each of which may count as large as the executor.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.options(**PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def text_batches(spark: SparkSession) -> Iterator[None]:
    """Steps that are planned and run in here send at most TEXT_ROWS rows at a time to Python."""
    before = spark.conf.get(ARROW_ROWS)
    spark.conf.set(ARROW_ROWS, min(int(before), TEXT_ROWS) if int(before) > 0 else TEXT_ROWS)
    try:
        yield
    finally:
        spark.conf.set(ARROW_ROWS, before)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else (``lower`` would change other letters too; for pure ASCII they agree)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_spread(rows: DataFrame, key: str, table: DataFrame, other: str, times: str, row: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Left join of ``rows`` with ``table`` (written, one row for each ``other``, which ``times`` rows have) without gathering the rows of a hot key.

    Keys of more than ``hot_rows`` rows are few and broadcast; their rows, and those with a
    null key, are spread by the string of column ``row`` over the shuffle that serves the rest.
    """
    names = [c for c in table.columns if c != other]
    hot = table.where(F.col(times) > hot_rows)
    if not small(hot, F.lit(100) + F.octet_length(other)):
        return rows.join(table, F.col(key) == F.col(other), "left").drop(other)
    hot = hot.select(F.col(other).alias("hot_key"), *[F.col(c).alias(f"hot_{c}") for c in names])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("hot_key"), "left")
    met = met.withColumn("hot_key", F.coalesce(F.when(F.col("hot_key").isNull(), F.col(key)), F.concat(F.lit("\u0000"), F.col(row).cast("string"))))
    met = met.join(table.where(F.col(times) <= hot_rows), F.col("hot_key") == F.col(other), "left")
    return met.select(*rows.columns, *[F.coalesce(f"hot_{c}", c).alias(c) for c in names])


def without_rows(docs: DataFrame, drops: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` less the rows whose id (null equals null) and text are in ``drops`` (materialised: drop_id, drop_sig = xxhash64 of the text)."""
    other = F.broadcast(drops) if small(drops) else drops
    return docs.join(other, docs[id_col].eqNullSafe(other["drop_id"]) & (F.xxhash64(docs[text_col]) == other["drop_sig"]), "left_anti")
