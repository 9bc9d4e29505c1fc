"""Shared folder and small helpers for the training-data operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDERS: dict[str, str] = {}
_WORKSPACES: list[Scratch] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session has none and runs on one machine (tests) a temporary folder takes its place; a cluster
    without one is refused.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or None
    if root is None:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN_FOLDERS:
            _OWN_FOLDERS[app] = tempfile.mkdtemp(prefix="tidewire-shared-")
        root = _OWN_FOLDERS[app]
    return root.rstrip("/")


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the current workspace, or else in the shared folder itself."""
    return f"{_WORKSPACES[-1].path if _WORKSPACES else shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """All intermediate tables of operators called inside go when it ends; write their results before that."""
    _WORKSPACES.append(Scratch(spark, "work"))
    try:
        yield
    finally:
        _WORKSPACES.pop().clear()


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write a (narrow) frame to the shared folder and read it again.

    The lineage ends there, so a lost executor costs a re-read instead of a recomputation, and a frame used
    several times is computed once. ``workspace`` clears it; outside of one the folder belongs to the job.
    """
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(text_col: str) -> Column:
    return F.coalesce(F.col(text_col).cast("string"), F.lit(""))


#: Tables after which the driver collects its garbage: the plans and broadcasts of past jobs, and with them their shuffles.
COLLECT_EVERY = 3


class Scratch:
    """A folder in the shared one for tables that an operator needs only while it runs.

    Clear it once all that was made from its tables is written itself: then no lineage leads back to it, and a lost
    executor still costs a re-read only.
    """

    def __init__(self, spark: SparkSession, tag: str, parent: Scratch | None = None):
        self.spark = spark
        self.path = f"{parent.path}/{tag}-{uuid.uuid4().hex}" if parent else shared_path(spark, tag)
        self.written = 0

    def write(self, df: DataFrame, tag: str) -> DataFrame:
        path = f"{self.path}/{tag}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.written += 1
        if self.written % COLLECT_EVERY == 0:
            self.spark.sparkContext._jvm.System.gc()
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        """Delete the folder, whatever store it is in, and let Spark free the shuffles that nothing refers to any more."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        jvm.System.gc()


_WORD_BITS = 32768  # positions in one bitmap of bitmap_construct_agg


def slot_of(bits: int, *keys: Column) -> Column:
    """One of ``2**bits`` slots, by the keys' hash."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def slot_bitmap(keys: DataFrame, slot: Column) -> DataFrame:
    """(__base, __bitmap) of the keys' slots; at most 2**bits / 32768 rows of 4 KB, so that it can be broadcast."""
    s = keys.select(slot.alias("s"))
    return s.groupBy(F.floor(F.col("s") / _WORD_BITS).alias("__base")).agg(F.bitmap_construct_agg(F.col("s") % _WORD_BITS).alias("__bitmap"))


def unused(columns: list[str], name: str) -> str:
    """A name close to ``name`` that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken or not name.startswith("__"):
        name = f"_{name}"
    return name


def with_slot(rows: DataFrame, bitmap: DataFrame, slot: Column, hit: str = "__hit") -> DataFrame:
    """``rows`` with a column ``hit``: whether the slot's bit is set. The bitmap's fixed size allows the broadcast."""
    base, bits = unused([*rows.columns, hit], "base"), unused([*rows.columns, hit], "bitmap")
    small = F.broadcast(bitmap.select(F.col("__base").alias(base), F.col("__bitmap").alias(bits)))
    joined = rows.join(small, F.floor(slot / _WORD_BITS) == F.col(base), "left")
    at = slot % _WORD_BITS
    byte = F.conv(F.hex(F.substring(bits, (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(hit, F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop(base, bits)


def split_keyed(rows: DataFrame, marks: DataFrame, key: str, mark: str, filter_bits: int = 24) -> tuple[DataFrame, DataFrame]:
    """(rows whose ``key`` is surely no ``mark``, all others), told by a bitmap of fixed size; nothing is shuffled."""
    hit = unused(rows.columns, "hit")
    told = with_slot(rows, slot_bitmap(marks, slot_of(filter_bits, F.col(mark))), slot_of(filter_bits, F.col(key)), hit)
    return told.filter(f"not {hit}").drop(hit), told.filter(hit).drop(hit)


def drop_keyed(docs: DataFrame, dropped: DataFrame, keys: list[str], filter_bits: int = 24) -> DataFrame:
    """Rows of ``docs`` whose key is not in ``dropped``; null keys are equal to each other.

    A bitmap of fixed size tells most rows that stay, which are not shuffled; only the others meet the dropped keys.
    All columns and repeated rows stay as they are; an empty ``dropped`` drops nothing, empty ``docs`` give no rows.
    """
    key, mark = unused(docs.columns, "key"), unused(docs.columns, "mark")
    one = lambda: F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    marks = materialize(dropped.select(one().alias(mark)).distinct(), "dropped")
    clear, maybe = split_keyed(docs.withColumn(key, one()), marks, key, mark, filter_bits)
    return clear.drop(key).unionByName(maybe.join(marks, F.col(key).eqNullSafe(F.col(mark)), "left_anti").drop(key))


def hash_bitmap(values: DataFrame, col: str, bits: int):
    """A numpy bitmap of ``2**bits`` bits, those of the top bits of a long column's values: a filter of fixed size.

    Tasks drop rows whose bit is unset; whatever it lets through is joined exactly afterwards.
    """
    import numpy as np

    slot = F.shiftrightunsigned(F.col(col), 64 - bits)
    s = values.select(slot.alias("s"))
    parts = s.groupBy((F.col("s") - F.col("s") % 32768).alias("base")).agg(F.bitmap_construct_agg(F.col("s") % 32768).alias("m")).toArrow()
    out = np.zeros((1 << bits) // 8, np.uint8)
    for base, m in zip(parts["base"].to_pylist(), parts["m"].to_pylist(), strict=True):
        out[base // 8 : base // 8 + len(m)] = np.frombuffer(m, np.uint8)
    return out
