"""Mixing sources to target weights by temperature.  DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import written

#: The exponent is a multiple of 1 / GRID.
GRID = 4096


def byte_tokens(text: Column) -> Column:
    """A token count without a tokenizer: four UTF-8 bytes a token, rounded up; null has none."""
    return F.coalesce(F.ceil(F.octet_length(text) / F.lit(4)), F.lit(0)).cast("long")


def _curve(shares: DataFrame, steps: list[int]) -> dict[int, tuple[float, float]]:
    """For exponents j / GRID: the sum of share**a, and the entropy of the weights; an aggregate over the sources."""
    x = shares.where("share > 0").select("share", F.explode(F.array(*[F.lit(j) for j in steps])).alias("j"))
    power = F.pow("share", F.col("j") / F.lit(float(GRID)))
    rows = x.groupBy("j").agg(F.sum(power).alias("z"), F.sum(power * F.ln("share")).alias("s")).collect()
    return {r.j: (r.z, math.log(r.z) - r.j / GRID * r.s / r.z) for r in rows}


def _bisect(shares: DataFrame, holds, largest: bool) -> int:
    """The largest (smallest) j in 0..GRID for which ``holds(j, z, entropy)``, which changes once along j.

    Six halvings share a job: the 63 midpoints that they can come to are evaluated together.
    """
    lo, hi = 0, GRID
    end = _curve(shares, [lo, hi])
    if largest:
        if not end or holds(hi, *end[hi]):
            return hi
        if not holds(lo, *end[lo]):
            return lo
    else:
        if not end or holds(lo, *end[lo]):
            return lo
        if not holds(hi, *end[hi]):
            return hi
    while hi - lo > 1:
        mids, spans = set(), [(lo, hi)]
        for _ in range(6):
            nxt = []
            for a, b in spans:
                if b - a > 1:
                    m = (a + b) // 2
                    mids.add(m)
                    nxt += [(a, m), (m, b)]
            spans = nxt
        curve = _curve(shares, sorted(mids))
        for _ in range(6):
            if hi - lo > 1:
                m = (lo + hi) // 2
                if holds(m, *curve[m]) == largest:
                    lo = m
                else:
                    hi = m
    return lo if largest else hi


def _permuted(thin: DataFrame, seed: int) -> DataFrame:
    """``thin(id, src, epoch, tokens)`` with key, block and start: the tokens before the row in its epoch's permutation.

    The permutation orders rows by a hash.  Prefix sums go down a trie of 256 branches on the hash, so that no task
    sorts a whole source: blocks are summed first, then the rows inside a leaf.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    x = thin.withColumn("key", key)
    levels = max(1, math.ceil(math.log(max(1, thin.count() / 65536), 256)) + 1)
    names = [f"b{i}" for i in range(levels)]
    for i, n in enumerate(names):
        x = x.withColumn(n, F.substring("key", 2 * i + 1, 2))
    x = written(x, "permuted")
    start = F.lit(0).cast("long")
    out = x
    for i in range(levels):
        on = ["src", "epoch", *names[: i + 1]]
        w = Window.partitionBy(*on[:-1]).orderBy(on[-1]).rowsBetween(Window.unboundedPreceding, -1)
        sums = x.groupBy(*on).agg(F.sum("tokens").alias("t")).withColumn(f"p{i}", F.coalesce(F.sum("t").over(w), F.lit(0)))
        sums = sums.select(*[F.col(c).alias(f"r_{c}") for c in on], f"p{i}")
        same = out["src"].eqNullSafe(sums["r_src"])
        for c in on[1:]:
            same = same & (out[c] == sums[f"r_{c}"])
        out = out.join(sums, same).drop(*[f"r_{c}" for c in on])
        start = start + F.col(f"p{i}")
    leaf = Window.partitionBy("src", "epoch", *names).orderBy("key", "id").rowsBetween(Window.unboundedPreceding, -1)
    start = start + F.coalesce(F.sum("tokens").over(leaf), F.lit(0))
    return out.withColumn("start", start).withColumn("block", F.conv("b0", 16, 10).cast("int"))


def mixing_plan(
    docs: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    tokens: Column | None = None,
    *,
    target_entropy: float | None = 0.9,
    max_repetition: float | None = 4.0,
    budget: int | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """The plan, one row for each source, and the thin table (id, src, tokens) that it was made from.

    Weights are share**a, normalised.  a is the largest value in 0..1 (natural shares: 1, equal: 0) whose weights
    have an entropy of at least ``target_entropy`` times that of equal weights; where a source would then be repeated
    more than ``max_repetition`` times, it is the smallest a that holds to this limit.  ``budget`` is in tokens;
    None: the least with which each source is seen once in full.  A source gets floor(quota / tokens) whole epochs
    and, of one more permutation, the rows that fit into the rest.  Null is a source like others; a source without
    tokens has weight 0 and is seen once where ``budget`` is None, else never.
    """
    count = byte_tokens(F.col("text")) if tokens is None else tokens
    thin = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), count.cast("long").alias("tokens")), "thin")
    stats = thin.groupBy("src").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("docs"))
    stats = written(stats, "sources")
    total = stats.agg(F.sum("t")).first()[0] or 0
    shares = stats.withColumn("share", F.col("t") / F.lit(float(max(total, 1))))
    top, least, k = shares.where("share > 0").agg(F.max("share"), F.min("share"), F.count(F.lit(1))).first()
    if not k:
        top, least = 1.0, 1.0

    def most(j, z, _):
        a = j / GRID
        return (top / least) ** (1 - a) if budget is None else budget / max(total, 1) * least ** (a - 1) / z

    j = GRID
    if target_entropy is not None:
        j = _bisect(shares, lambda _, __, h: h >= target_entropy * math.log(max(k, 1)), largest=True)
    if max_repetition is not None and k:
        z, h = _curve(shares, [j])[j]
        if most(j, z, h) > max_repetition:
            j = _bisect(shares, lambda *x: most(*x) <= max_repetition, largest=False)
    a = j / GRID
    z = _curve(shares, [j])[j][0] if k else 1.0
    weight = F.when(F.col("share") > 0, F.pow("share", F.lit(a)) / F.lit(z)).otherwise(F.lit(0.0))
    if budget is None:
        epochs = F.when(F.col("share") > 0, F.pow(F.lit(top) / F.col("share"), F.lit(1 - a))).otherwise(F.lit(1.0))
    else:
        epochs = F.when(F.col("share") > 0, weight * F.lit(float(budget)) / F.col("t")).otherwise(F.lit(0.0))
    plan = (
        shares.withColumn("weight", weight)
        .withColumn("epochs", epochs)
        .withColumn("whole", F.floor("epochs").cast("int"))
        .withColumn("rest", F.floor((F.col("epochs") - F.col("whole")) * F.col("t")).cast("long"))
        .withColumn("alpha", F.lit(a))
    )
    plan = written(plan, "plan")
    last = thin.join(plan.select(F.col("src").alias("p_src"), "whole", "rest"), F.col("src").eqNullSafe(F.col("p_src"))).where("rest > 0")
    last = _permuted(last.select("id", "src", F.col("whole").alias("epoch"), "tokens", "rest"), seed)
    # while they fit: starts grow along the permutation, so those that fit are before one key ("~" is after all of them)
    over = F.when(F.col("start") + F.col("tokens") > F.col("rest"), F.col("key"))
    cut = last.groupBy(F.col("src").alias("c_src")).agg(F.coalesce(F.min(over), F.lit("~")).alias("cut"))
    plan = written(plan.join(cut, F.col("src").eqNullSafe(F.col("c_src")), "left").drop("c_src"), "plan")
    return plan, thin


def _epochs(rows: DataFrame, plan: DataFrame, id_col, src_col, seed: int) -> DataFrame:
    """``rows`` once for each epoch in which the plan takes them."""
    p = plan.select(F.col("src").alias("__cs_src"), F.col("whole").alias("__cs_w"), F.col("cut").alias("__cs_cut"))
    x = rows.join(p, rows[src_col].eqNullSafe(p["__cs_src"]))
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("__cs_w").cast("string"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    times = F.col("__cs_w") + F.when(key < F.col("__cs_cut"), 1).otherwise(0)
    spread = F.when(times > 0, F.sequence(F.lit(0), times - 1)).otherwise(F.array().cast("array<int>"))
    return x.withColumn("__cs_epoch", F.explode(spread)).drop("__cs_src", "__cs_w", "__cs_cut")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", tokens: Column | None = None, *, seed: int = 17, **target) -> DataFrame:
    """One row for each copy that the mixture takes: id, source, epoch, block, tokens, start, weight.

    ``start``: tokens before it in its source's permutation of that epoch, blocks being runs of it.  See
    ``mixing_plan`` for the targets.  An empty table gives no rows.  Rows that repeat an id are taken alike: in a
    source's last epoch none of them where they do not all fit.  A null source is a source, and a null id an id; a text
    that is null or empty has no tokens and comes once for each whole epoch.
    """
    plan, thin = mixing_plan(docs, id_col, source_col, tokens, seed=seed, **target)
    rows = _epochs(thin, plan, "id", "src", seed).withColumnRenamed("__cs_epoch", "epoch")
    out = _permuted(rows, seed)
    w = plan.select(F.col("src").alias("w_src"), F.round("weight", 9).alias("weight"))
    return out.join(w, F.col("src").eqNullSafe(F.col("w_src"))).select(
        F.col("id").alias(id_col), F.col("src").alias(source_col), "epoch", "block", "tokens", "start", "weight"
    )


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", *, seed: int = 17, **target) -> DataFrame:
    """``docs`` itself in the mixture: each row as often as the plan takes it, with its columns.  Texts are not shuffled.

    Nulls, repeated ids and empty tables: as in ``mix_sources``.
    """
    plan, _ = mixing_plan(docs, id_col, source_col, byte_tokens(F.col(text_col)), seed=seed, **target)
    return _epochs(docs, plan, id_col, source_col, seed).select(*docs.columns)
