"""Shards that balance bytes, tokens and rows jointly by vector bin packing."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import slots, written

#: Groups below the heavy limit are dealt by hash to so many cells, and the cells are placed.
CELLS = 16384
#: A group of over this share of a shard is placed by itself.
HEAVY = 1 / 64
#: Pieces of a cut group are about this share of a shard, and no smaller group is cut.
PIECE = 1 / 4
#: A shard of over this many times its share of bytes is too full: a group in it is cut.
FULL = 1.05
#: A shard has room for an item that takes it over by at most this share, which leaves the other dimensions some play.
OVER = 0.005


def word_tokens(text: Column) -> Column:
    """Spaces plus one; null and empty have none."""
    n = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(n).cast("long")


def place(sizes: np.ndarray, shards: int, weights=(4.0, 1.0, 1.0)) -> np.ndarray:
    """The shard of each item: largest first, where item times residual capacity (a dot product) is highest among
    the shards that have room for it in the first dimension, or among all where none has.

    ``sizes``: items x dimensions.  Each dimension counts as a share of a shard's capacity; the first is weighted.
    Ties go to the lower shard.
    """
    cap = np.maximum(sizes.sum(axis=0) / shards, 1e-9)
    unit = sizes / cap
    residual = np.ones((shards, sizes.shape[1]))
    out = np.zeros(len(sizes), dtype=np.int32)
    w = np.asarray(weights)
    order = np.lexsort((np.arange(len(sizes)), -unit[:, 1], -unit[:, 0]))
    for i in order:
        gain = residual @ (unit[i] * w)
        fits = residual[:, 0] >= unit[i, 0] - OVER
        s = int(np.argmax(np.where(fits, gain, -np.inf) if fits.any() else gain))
        out[i] = s
        residual[s] -= unit[i]
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row for each document: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `bytes`: sizes near equal, tokens and rows balanced with them.  Equal texts are a group and share a
    shard, unless they exceed a shard, or the groups as they are leave a shard too full; then the group (of those in a
    full shard the smallest of over PIECE) is cut by a hash of the id, and all is placed anew.  Groups of at most HEAVY
    of a shard are hashed to CELLS cells, and the cells are placed.  The driver places at most CELLS cells and
    shards / HEAVY heavy groups and their pieces, whatever the input.  Null text has size
    ``overhead``.  Rows that repeat an id keep slots of their own.  An empty table gives no rows.
    """
    text = F.col(text_col)
    thin = written(
        docs.select(
            F.col(id_col).alias("id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
            F.crc32(F.coalesce(text, F.lit(""))).alias("crc"),
            word_tokens(text).alias("tokens"),
            F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"),
        ),
        "sizes",
    )
    spark = docs.sparkSession
    total = thin.agg(F.sum("size")).first()[0] or 0
    cap = max(1.0, total / shards)
    # at most shards / HEAVY groups can be so large
    heavy = thin.groupBy("h").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n")).where(F.col("s") > HEAVY * cap).orderBy("h").collect()
    cut = {g.h for g in heavy if g.s > cap}
    cell = F.pmod(F.xxhash64("h"), F.lit(CELLS)).cast("int")
    own = F.col("item") + F.pmod(F.xxhash64("id", F.lit("cut")), F.col("cuts")).cast("int")
    while True:
        rows, item, whole = [], CELLS, {}
        for g in heavy:
            cuts = int(np.ceil(g.s / (PIECE * cap))) if g.h in cut else 1
            rows.append((g.h, item, cuts))
            if g.h not in cut and g.n > 1 and g.s > PIECE * cap:
                whole[item] = g
            item += cuts
        big = spark.createDataFrame(rows, "g long, item int, cuts int")
        placed = thin.join(F.broadcast(big), F.col("h") == F.col("g"), "left").withColumn("unit", F.coalesce(own, cell)).drop("g", "item", "cuts", "h")
        sums = placed.groupBy("unit").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).orderBy("unit").collect()
        at = place(np.array([[r.b, r.t, r.n] for r in sums], dtype=float).reshape(-1, 3), shards)
        full = np.bincount(at, weights=[r.b for r in sums], minlength=shards) > FULL * cap
        least = {}  # of each full shard the smallest group that can be cut
        for r, s in zip(sums, at.tolist(), strict=True):
            if full[s] and r.unit in whole and (s not in least or whole[r.unit].s < least[s].s):
                least[s] = whole[r.unit]
        if not least:
            break
        cut |= {g.h for g in least.values()}
    where = spark.createDataFrame([(r.unit, int(s)) for r, s in zip(sums, at, strict=True)], "u int, shard int")
    placed = written(placed.join(F.broadcast(where), F.col("unit") == F.col("u")).select("id", "size", "crc", "shard"), "placed")
    return slots(placed, "shard", ["id", "crc"], "slot").select(
        F.col("id").alias(id_col),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
