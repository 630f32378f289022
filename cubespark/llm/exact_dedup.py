"""Exact duplicates through an extendible-hash index on shared files.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import ascii_lower, fitting, shared_dir, written

#: Distinct keys that a bucket holds before it splits.
CAPACITY = 4096
#: Bits of a key.
BITS = 62
#: Buckets of one owner task, which writes their files.
OWNED = 64


def _norm(text_col: str) -> Column:
    return ascii_lower(F.coalesce(F.col(text_col), F.lit("")))


def _key(norm: Column, bits: int = BITS) -> Column:
    """The hash of a text as a long that is never negative; ``bits`` of it count, the others are 0."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(norm), 64 - bits), BITS - bits)


def _prefix(key: Column, depth: int) -> Column:
    return F.shiftright(key, BITS - depth) if depth else F.lit(0).cast("long")


def directory(keys: DataFrame, capacity: int = CAPACITY) -> tuple[DataFrame, int]:
    """(slot, bucket, depth) of an extendible hash over ``keys(key)`` (distinct, written), written; and its global depth.

    It starts with a slot for each ``capacity`` keys.  While a bucket of the global depth has more keys than that, it
    splits by its next bit and the directory doubles: a slot is a prefix of the global depth, and the slots that no
    split told apart point to one bucket, a prefix of its own, lesser depth.
    """
    depth = max(0, math.ceil(math.log2(max(1, keys.count() / capacity))))
    slots = keys.groupBy(_prefix(F.col("key"), depth).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    slots = written(slots.select("slot", F.col("slot").alias("bucket"), F.lit(depth).alias("depth"), "n"), "slots")
    while depth < BITS:
        full = slots.where((F.col("n") > capacity) & (F.col("depth") == depth)).select(F.col("bucket").alias("full"))
        if full.isEmpty():
            break
        half = keys.join(fitting(full), _prefix(F.col("key"), depth) == F.col("full")).groupBy(_prefix(F.col("key"), depth + 1).alias("slot")).agg(F.count(F.lit(1)).alias("n"))
        half = half.select("slot", F.col("slot").alias("bucket"), F.lit(depth + 1).alias("depth"), "n")
        rest = slots.join(fitting(full), (F.col("bucket") == F.col("full")) & (F.col("depth") == depth), "left_anti")
        rest = rest.withColumn("slot", F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)))
        slots, depth = written(rest.union(half), "slots"), depth + 1
    return slots.drop("n"), depth


def routed(rows: DataFrame, slots: DataFrame, depth: int) -> DataFrame:
    """``rows(key, ...)`` with the bucket and its depth, which the key's slot of the directory names."""
    to = fitting(slots.select(F.col("slot").alias("to_slot"), "bucket", "depth"))
    return rows.join(to, _prefix(F.col("key"), depth) == F.col("to_slot")).drop("to_slot")


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = BITS) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """(rows, index, directory, global depth), all written to the shared folder.

    Rows: id, key, sha of each row.  Index: bucket, depth, key, chain, sha, keep_id, n; one entry for each distinct
    text, in files that an owner task of a range of buckets writes in order.  A key that one row has needs no look at
    its text.  Of all others the texts go to their key's owner, who compares them byte by byte (copies meet before
    they travel, so a text that a third of all rows carry goes once from each task), decides which id stays, and
    chains different texts of one key.  ``key_bits``: fewer bits make such chains frequent.
    """
    spark = docs.sparkSession
    norm = _norm(text_col)
    rows = written(docs.select(F.col(id_col).alias("id"), _key(norm, key_bits).alias("key"), F.sha2(norm, 256).alias("sha")), "rows")
    keys = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("keep_id"), F.max("sha").alias("sha"))
    keys = written(keys, "keys")
    slots, depth = directory(keys.select("key"), capacity)
    shared = fitting(written(keys.where("n > 1").select(F.col("key").alias("k")), "shared"))
    texts = docs.select(F.col(id_col).alias("id"), norm.alias("norm"), _key(norm, key_bits).alias("key"))
    many = texts.join(shared, F.col("key") == F.col("k"), "left_semi").groupBy("key", "norm").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    many = many.select("key", F.sha2("norm", 256).alias("sha"), "keep_id", "n")
    entries = many.union(keys.where("n = 1").select("key", "sha", "keep_id", "n"))
    entries = routed(entries, slots, depth).withColumn("chain", F.row_number().over(Window.partitionBy("key").orderBy("sha")))
    path = f"{shared_dir(spark)}/index"
    first = F.expr(f"shiftleft(bucket, {BITS} - depth)")
    owners = max(1, math.ceil(slots.select("bucket", "depth").distinct().count() / OWNED))
    index = entries.select("bucket", "depth", "key", "chain", "sha", "keep_id", "n")
    index.repartitionByRange(owners, first, "key").sortWithinPartitions(first, "key", "chain").write.parquet(path)
    return rows, spark.read.schema(index.schema).parquet(path), slots, depth


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, key_bits: int = BITS) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when the same after lower-casing A-Z only; null counts as empty.  The largest id of a group
    stays.  Rows that repeat an id count once each in group_size and share the outcome; a null id stays only where
    its group has no other.  An empty table gives no rows.  Columns other than the two named are not read.
    """
    rows, index, slots, depth = build_index(docs, id_col, text_col, capacity, key_bits)
    many = index.where("n > 1").select(F.col("bucket").alias("b"), F.col("depth").alias("d"), F.col("key").alias("k"), F.col("sha").alias("s"), "keep_id", "n")
    here = (F.col("bucket") == F.col("b")) & (F.col("depth") == F.col("d")) & (F.col("key") == F.col("k")) & (F.col("sha") == F.col("s"))
    found = routed(rows, slots, depth).join(fitting(many), here, "left")
    keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row for each text, all its columns untouched: the row of the largest id.

    Rows are judged one by one, so an id that comes with several texts keeps one row of each text it wins.  Of rows
    equal in id and text any one stays, whatever their other columns.  Rows without an id stay where their text has
    none with an id, one of them.
    """
    rows, index, _, _ = build_index(docs, id_col, text_col)
    many = index.where("n > 1").select(F.col("key").alias("__cs_k"), F.col("sha").alias("__cs_s"), F.col("keep_id").alias("__cs_keep"))
    again = rows.join(fitting(many), (F.col("key") == F.col("__cs_k")) & (F.col("sha") == F.col("__cs_s")) & F.col("id").eqNullSafe(F.col("__cs_keep")))
    again = again.groupBy("__cs_k", "__cs_s").agg(F.count(F.lit(1)).alias("__cs_n"))  # rows that could stay for a text
    many = written(many.join(again, ["__cs_k", "__cs_s"]), "copies")
    one = fitting(written(many.select("__cs_k").distinct(), "keys").select(F.col("__cs_k").alias("__cs_one")))
    norm = _norm(text_col)
    x = docs.withColumn("__cs_key", _key(norm)).join(one, F.col("__cs_key") == F.col("__cs_one"), "left")
    # a second hash only where the first is shared
    x = x.withColumn("__cs_sha", F.when(F.col("__cs_one").isNotNull(), F.sha2(norm, 256))).drop("__cs_one")
    x = x.join(fitting(many), (F.col("__cs_key") == F.col("__cs_k")) & (F.col("__cs_sha") == F.col("__cs_s")), "left")
    x = x.where(F.col("__cs_s").isNull() | F.col(id_col).eqNullSafe(F.col("__cs_keep")))
    out = x.where(F.coalesce("__cs_n", F.lit(1)) == 1).select(*docs.columns)
    if many.where("__cs_n > 1").isEmpty():
        return out
    return out.union(x.where("__cs_n > 1").dropDuplicates(["__cs_k", "__cs_s"]).select(*docs.columns))
