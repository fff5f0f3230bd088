"""What the operators share: reading tables, staging results, shipping code, joins that hold hot keys."""

from __future__ import annotations

import ctypes
import io
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_FOLDER: dict[str, str] = {}
_SHIPPED: set[str] = set()
_STEPS: list[list[str]] = []

#: Rows of one key that meet in a task; the rows of a hotter key are dealt into pieces.
KEY_ROWS = 512
#: Rows up to which a side of narrow rows (some dozens of bytes each) is broadcast.
BROADCAST_ROWS = 100_000
#: Rows of whole documents that go to a Python worker at once, where the session has Spark's own default of 10,000.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The shared folder of the cluster (spark.checkpoint.dir); one of our own only where none is named and all runs on this machine."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_FOLDER:
        _OWN_FOLDER[app] = tempfile.mkdtemp(prefix="spark-lodeworks-")
        spark.sparkContext.setCheckpointDir(_OWN_FOLDER[app])
    return _OWN_FOLDER[app]


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage is cut, and a lost
    executor loses nothing that is already written."""
    path = f"{scratch(df.sparkSession)}/lodeworks/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for steps in _STEPS:
        steps.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def passing_steps(spark: SparkSession) -> Iterator[None]:
    """What is staged inside is deleted at the end; results must have been written elsewhere by then."""
    steps: list[str] = []
    _STEPS.append(steps)
    try:
        yield
    finally:
        _STEPS.remove(steps)
        jvm, settings = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in steps:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(settings).delete(place, True)


def shipped(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no copy of the repository; and
    keep Arrow batches small, since a row holds a whole text."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    if not package.is_dir():  # already imported from an archive
        return
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*.py")):
            z.write(f, f.relative_to(package.parent))
    folder = tempfile.mkdtemp(prefix="spark-lodeworks-code-")
    target = os.path.join(folder, "lodeworks_code.zip")
    Path(target).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def handed_back() -> None:
    """Give the memory that a task has freed (a batch, where one frees much) back to the machine, since its Python worker outlives it and serves later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def unused(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def hot_keys(rows: DataFrame, keys: list[str], counts: DataFrame | None = None, most: int = KEY_ROWS) -> DataFrame | None:
    """(keys, pieces) of the keys that more than ``most`` of ``rows`` have; None if there are none. ``counts``: (keys, k), if at hand.
    A hot key has more than ``most`` rows, so there are at most rows / ``most`` of them."""
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count("*").alias("k"))
    hot = staged(counts.where((F.col("k") > most) & F.col(keys[0]).isNotNull()).select(*keys, F.ceil(F.col("k") / most).cast("int").alias("pieces")), "hot")
    return None if hot.isEmpty() else hot


def joined(many: DataFrame, one: DataFrame, keys: list[str], by: list[str], how: str = "inner", counts: DataFrame | None = None, most: int = KEY_ROWS) -> DataFrame:
    """``many`` joined (inner or left) with ``one``, which has each key once. The rows of a hot key are dealt into pieces by the
    hash of ``by``, and the key's row of ``one`` goes to each piece, so that no key meets in one task. Rows without a key
    stay where they are. The rows of ``many`` should be staged, or cheap to make."""
    apart = None
    if how == "left":
        absent = F.lit(False)
        for k in keys:
            absent = absent | F.col(k).isNull()
        added = [F.lit(None).cast(one.schema[c].dataType).alias(c) for c in one.columns if c not in keys]
        apart, many = many.where(absent).select("*", *added), many.where(~absent)
    hot = hot_keys(many, keys, counts, most)
    if hot is None:
        out = many.join(one, keys, how)
    else:
        few = hot.count() <= BROADCAST_ROWS
        hot = F.broadcast(hot) if few else hot
        pieces = F.coalesce("pieces", F.lit(1))
        dealt = many.join(hot, keys, "left").withColumn("piece", F.pmod(F.xxhash64(*by), pieces).cast("int")).drop("pieces")
        copied = one.join(hot, keys, "left").withColumn("piece", F.explode(F.sequence(F.lit(0), pieces - 1))).drop("pieces")
        out = dealt.join(copied, [*keys, "piece"], how).drop("piece")
    return out if apart is None else out.unionByName(apart)
