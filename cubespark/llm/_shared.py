"""What the corpus operators share: the shared folder, written tables, code shipping, ranks and components."""

from __future__ import annotations

import atexit
import ctypes
import getpass
import math
import os
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Keys that may be broadcast: 1,000,000 longs take about 32 MB as a hash relation.
BROADCAST_KEYS = 1_000_000

#: Spark's bound of a batch for Python.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_made: list[tuple[SparkSession, str]] = []
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder of this machine, but only if executors run here as well.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file:{tempfile.gettempdir()}/cubespark-{getpass.getuser()}"
    path = f"{base.rstrip('/')}/cubespark/{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session is gone: whoever owns the shared folder removes it
            return


def written(df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts lineage and survives lost executors.

    ``batch``: about so many bytes go to a Python worker at a time, for the time of this write and where the session
    sets nothing itself.  The JVM holds up to three times a batch for each task beside its heap, the worker holds it once more.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}"
    bound = batch is not None and spark.conf.get(BATCH_BYTES, None) is None
    if bound:
        spark.conf.set(BATCH_BYTES, str(batch))
    try:
        df.write.parquet(path)
    finally:
        if bound:
            spark.conf.unset(BATCH_BYTES)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Sends the package's code to the executors once for each application, so that Python tasks can import it."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(root)
    path = os.path.join(tempfile.mkdtemp(), f"{name}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(root):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, root)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def release() -> None:
    """Gives memory that this process no longer uses back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(work):
    """``work`` for ``mapInArrow``, and ``release`` at its end, as a worker stays for later tasks."""

    def run(batches):
        yield from work(batches)
        release()

    return run


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else.  ``lower`` does just that for texts of ASCII alone, and is much the faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fitting(table: DataFrame) -> DataFrame:
    """``table`` (written) with the hint that its counted rows allow: to broadcast it, or else to sort and merge."""
    return table.hint("broadcast" if table.count() <= BROADCAST_KEYS else "merge")


def without_ids(docs: DataFrame, drop: DataFrame, id_col: str) -> DataFrame:
    """``docs`` less the ids in ``drop`` (a written table): a broadcast where its counted size allows, else a shuffle."""
    drop = drop.select(F.col(id_col).alias("__cs_id"))
    return docs.join(fitting(drop), docs[id_col] == drop["__cs_id"], "left_anti")


def only_ids(docs: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """``docs`` with the ids in ``ids`` (a written table), in the same two ways."""
    ids = ids.select(F.col(id_col).alias("__cs_id"))
    return docs.join(fitting(ids), docs[id_col] == ids["__cs_id"], "left_semi")


def slots(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """``df`` (a written table) with ``name``: the row's place, from 0 and gapless, among the rows of its ``key``.

    No task sorts a whole key: rows go to about sqrt(n) buckets by a hash of ``order``, are counted by bucket and
    numbered inside it.  ``key`` must not be null and ``order`` must name a row, or ties are broken at will.
    """
    b = max(1, math.isqrt(df.count()))
    x = df.withColumn("__cs_b", F.pmod(F.xxhash64(*order), F.lit(b)).cast("int"))
    inside = Window.partitionBy(key, "__cs_b").orderBy(*order)
    before = Window.partitionBy("__cs_k").orderBy("__cs_c").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        x.groupBy(F.col(key).alias("__cs_k"), F.col("__cs_b").alias("__cs_c"))
        .agg(F.count(F.lit(1)).alias("__cs_n"))
        .withColumn("__cs_p", F.coalesce(F.sum("__cs_n").over(before), F.lit(0)))
        .drop("__cs_n")
    )
    x = x.withColumn("__cs_r", F.row_number().over(inside))
    joined = x.join(counts, (x[key] == counts["__cs_k"]) & (x["__cs_b"] == counts["__cs_c"]))
    return joined.withColumn(name, F.col("__cs_p") + F.col("__cs_r") - 1).select(*df.columns, name)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)`` by alternating large and small stars: (node, root), root the least node.

    Each round is written to the shared folder.  It ends when a round changes nothing; ``max_rounds`` is far above
    the logarithm of any edge count and raises where it is passed, so no link is lost in silence.
    """
    cur = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    state = None
    for _ in range(max_rounds):
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(low, both["u"] == low["k"]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), "m")
        small = large.join(low, large["u"] == low["k"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        nxt = written(small.union(low.select("k", "m")).distinct(), "edges")
        now = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        cur = nxt
        if state == tuple(now):
            return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(now)
    raise RuntimeError("components did not settle")
