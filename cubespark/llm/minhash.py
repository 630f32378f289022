"""Near duplicates by DartMinHash signatures, banded candidates and exact similarity."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import components, fitting, only_ids, ship, tidy, without_ids, written

WORDS, SIMILARITY = 5, 0.8
#: 20 bands of 4 coordinates: a pair at 0.8 shares a band with probability 1 - (1 - 0.8**4)**20 = 0.99997.
BANDS, ROWS = 20, 4
#: Bytes of text that are hashed at a time.
SLICE = 1 << 18
#: Rounds in which one document of a key speaks for its class, before all of two classes meet.
LED = 2
#: Classes of set sizes to a factor of e.
CLASSES = 50

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE to the powers 0..n and to their negatives, modulo 2**64."""
    if not _powers or len(_powers[0]) <= n:
        m = max(n, SLICE) + 1
        inv = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(m, b, np.uint64)))) for b in (_BASE, inv)]
    return _powers[0], _powers[1]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, end to end, and where each text's words end.

    Words are split at white space (space, tab, line ends); letters of all scripts are lower-cased first.
    """
    texts = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offs[0] : offs[-1]]
    offs = offs - offs[0]
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
    before = np.concatenate(([True], blank[:-1]))
    edge = offs[1:-1]
    before[edge[edge < len(raw)]] = True
    after = np.concatenate((blank[1:], [True]))
    after[edge[(edge > 0)] - 1] = True
    start, end = np.flatnonzero(~blank & before), np.flatnonzero(~blank & after) + 1
    h, i = np.zeros(len(start), np.uint64), 0
    while i < len(start):  # about SLICE bytes at a time, cut between words, however long the text
        j = max(i + 1, int(np.searchsorted(end, start[i] + SLICE, side="right")))
        part, low, high = raw[start[i] : end[j - 1]], start[i:j] - start[i], end[i:j] - start[i]
        up, down = _power(len(part))
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)))
        h[i:j] = (total[high] - total[low]) * down[low]
        i = j
    h = _mix(h + (end - start).astype(np.uint64) * np.uint64(_BASE))
    return h, np.searchsorted(start, offs[1:], side="left")


def shingles(texts: pa.Array, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, counts, ends): the distinct shingles of each text, sorted, how often each occurs, where a text's end.

    A text of fewer words than ``words``, but at least one, is a single shingle; a text without a word has none.
    """
    h, ends = word_hashes(texts)
    starts = np.concatenate(([0], ends[:-1]))
    n = ends - starts
    k = np.where(n >= words, n - words + 1, np.minimum(n, 1))
    doc = np.repeat(np.arange(len(n)), k)
    place = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    at = starts[doc] + place
    s = np.zeros(len(at), np.uint64)
    for i in range(words):
        ok = at + i < ends[doc]
        w = np.where(ok, h[np.minimum(at + i, max(len(h) - 1, 0))], np.uint64(0)) if len(h) else s
        s = _mix(s * np.uint64(3) + w + np.uint64(i + 1))
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    counts = np.diff(np.append(first, len(s)))
    return s[first], counts, np.searchsorted(doc[first], np.arange(len(n)), side="right")


def dart_minhash(items: np.ndarray, weights: np.ndarray, ends: np.ndarray, k: int, seed: int = 5) -> np.ndarray:
    """sets x k signature of weighted sets; the share of equal coordinates estimates their weighted Jaccard similarity.

    An item's region is the strip from 0 to its weight, in slabs [0, 1), [1, 2), [2, 4), ... Hashed darts fall on it
    evenly at a rate of k (ln k + 3), in order of rank: within a slab the gaps between ranks are exponential, so a
    dart is drawn only while its rank is below 1 / (total weight).  A dart has a height and a coordinate; it counts
    where its height is below the weight.  Each coordinate keeps the dart of least rank.  Sets with a coordinate
    without a dart look twice as far, and so on, until each has one: darts found before stay the earliest.  Most
    items get no dart, which costs one hash.  An empty set has zeros.
    """
    n = len(ends)
    starts = np.concatenate(([0], ends[:-1]))
    sig, rank = np.zeros((n, k), np.uint64), np.full((n, k), np.inf)
    if not len(items):
        return sig
    owner = np.repeat(np.arange(n), ends - starts)
    total = np.bincount(owner, weights=weights, minlength=n)
    rate = k * (math.log(k) + 3.0)
    # a row for each slab that an item's weight reaches
    slabs = 1 + np.ceil(np.log2(np.maximum(weights, 1.0))).astype(np.int64)
    row = np.repeat(np.arange(len(items)), slabs)
    slab = np.arange(len(row)) - np.repeat(np.cumsum(slabs) - slabs, slabs)
    low = np.where(slab == 0, 0.0, 2.0 ** (slab - 1))
    width = np.where(slab == 0, 1.0, 2.0 ** (slab - 1)) * rate
    base = items[row] ^ _mix(slab.astype(np.uint64) + np.uint64(seed * 1000 + 1))
    todo, far = np.ones(n, bool), 1.0
    while todo.any():
        who = owner[row]
        live = np.flatnonzero(todo[who])
        reach = far / total[who[live]]
        at, step = np.zeros(len(live)), 0
        found: list[tuple[np.ndarray, ...]] = []
        while len(live):
            step += 1
            h = _mix(base[live] + np.uint64(step * _BASE & (1 << 64) - 1))
            u = ((h >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53
            at = at - np.log(u) / width[live]
            ok = at <= reach
            live, at, reach, h = live[ok], at[ok], reach[ok], h[ok]
            if not len(live):
                break
            g = _mix(h ^ _M2)
            height = low[live] + (g >> np.uint64(40)).astype(np.float64) * 2.0**-24 * (width[live] / rate)
            hit = height < weights[row[live]]
            found.append((who[live][hit], (g[hit] & np.uint64(0xFFFFFFFF)) % np.uint64(k), at[hit], _mix(g[hit])))
        if found:
            d, j, r, h = (np.concatenate(x) for x in zip(*found, strict=True))
            cell = d * k + j.astype(np.int64)
            order = np.lexsort((h, r, cell))
            cell, r, h = cell[order], r[order], h[order]
            first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
            sig.reshape(-1)[cell[first]], rank.reshape(-1)[cell[first]] = h[first], r[first]
        todo &= np.isinf(rank).any(axis=1) & (total > 0)
        far *= 2
    return sig


def _slices(texts: pa.Array):
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)) if len(texts) else np.zeros(0)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + SLICE, side="right")))
        yield i, texts.slice(i, j - i)
        i = j


def signatures(docs: DataFrame, id_col: str, text_col: str, weighted: bool = True) -> DataFrame:
    """(id, same, same2, n, bands), written: a hash of the shingle set, its size, and what finds its likes.

    Texts without a word have n = 0 and no bands.  ``weighted``: a shingle weighs as often as it occurs, else 1.
    """
    ship(docs.sparkSession)

    def work(batches):
        for b in batches:
            for i, texts in _slices(b.column("text")):
                s, counts, ends = shingles(texts)
                if not weighted:
                    counts = np.ones_like(counts)
                starts = np.concatenate(([0], ends[:-1]))
                sig = dart_minhash(s, counts.astype(float), ends, BANDS * ROWS)
                own = s * np.uint64(3) + counts.astype(np.uint64)
                sums = [np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mix(own + np.uint64(c)), dtype=np.uint64))) for c in (1, 2)]
                same = [(x[ends] - x[starts]).view(np.int64) for x in sums]
                keys = np.zeros((len(ends), BANDS), np.uint64)
                for r in range(ROWS):
                    keys = _mix(keys * np.uint64(5) + sig.reshape(len(ends), BANDS, ROWS)[:, :, r] + np.arange(BANDS, dtype=np.uint64))
                total = np.concatenate(([0], np.cumsum(counts)))
                n = total[ends] - total[starts]
                flat = keys[n > 0].view(np.int64).reshape(-1)
                off = np.concatenate(([0], np.cumsum(np.where(n > 0, BANDS, 0)))).astype(np.int32)
                yield pa.record_batch(
                    {"id": b.column("id").slice(i, len(texts)), "same": pa.array(same[0]), "same2": pa.array(same[1]), "n": pa.array(n), "bands": pa.ListArray.from_arrays(pa.array(off), pa.array(flat))}
                )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    return written(rows.mapInArrow(tidy(work), "id long, same long, same2 long, n long, bands array<long>"), "signatures")


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, weighted: bool = True) -> DataFrame:
    """(id, n, s) of the documents in ``ids(id)`` (written): the hashes of a text's shingles, written.

    ``weighted``: the second and later occurrence of a shingle have hashes of their own, so that similarities of these
    sets are the weighted ones.  An id that comes with several texts has a row for each.
    """
    ship(docs.sparkSession)

    def work(batches):
        for b in batches:
            for i, texts in _slices(b.column("text")):
                s, counts, ends = shingles(texts)
                total = np.concatenate(([0], np.cumsum(counts)))
                if weighted:
                    s, ends = np.repeat(s, counts), total[ends]
                    nth = np.arange(len(s)) - np.repeat(total[:-1], counts)
                    s = np.where(nth > 0, _mix(s + nth.astype(np.uint64) * np.uint64(_BASE)), s)
                off = np.concatenate(([0], ends)).astype(np.int32)
                yield pa.record_batch({"id": b.column("id").slice(i, len(texts)), "n": pa.array(np.diff(off).astype(np.int64)), "s": pa.ListArray.from_arrays(pa.array(off), pa.array(s.view(np.int64)))})

    texts = only_ids(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")), ids, "id")
    sets = written(texts.mapInArrow(tidy(work), "id long, n long, s array<long>"), "sets")
    named = sets.select("id").groupBy("id").count().where("count > 1")
    return sets if named.isEmpty() else written(sets.distinct(), "sets")


def _overlap(least: float, a, b):
    """The least number of shingles in common by which sets of ``a`` and ``b`` can have a similarity of ``least``."""
    return F.ceil((a + b) * (least / (1 + least)) - 1e-9)


def similar(pairs: DataFrame, sets: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The rows of ``pairs(a, b, ...)`` of which the ``sets`` have a Jaccard similarity of ``least`` or more, written."""
    x = pairs.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("s").alias("sb")), "b")
    x = x.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("s").alias("sa")), "a")
    alike = F.size(F.array_intersect("sa", "sb")) >= _overlap(least, F.col("na"), F.col("nb"))
    return written(x.where("na > 0 and nb > 0").where(alike).select(*pairs.columns).distinct(), "links")


def _prefixes(torn: DataFrame, least: float) -> DataFrame:
    """(key, id, root, fame, n, own, c, left), written, of ``torn(id, root, fame, n, set, s)`` (written; set is a hash of s).

    Two sets that can reach ``least`` share a key.

    Prefix filtering: with all shingles in one order, the rarest first, two sets with an overlap of o have a shingle in
    common among the first n - o + 1 of either, and at the first of these both have o left.  The overlap that a pair
    needs depends on both sizes, so a set shows the prefix that each class of sizes asks for, under a key of the
    shingle and the two classes.  Common text is thus never a key, unless sets have little else, and then they are
    near copies of each other.  own and c are the classes of the set and of the partners it faces under the key, left
    is how many of its shingles stand at this one and after it.
    """
    size_class = lambda n: F.floor(F.log(n) * CLASSES + 1e-9)
    each = torn.select("id", "root", "fame", "n", "set", F.explode("s").alias("t"))
    often = each.groupBy("t").agg(F.count(F.lit(1)).alias("f")).where("f > 1").withColumnRenamed("t", "t2")
    shared = each.join(often, F.col("t") == F.col("t2")).groupBy("id", "root", "fame", "n", "set").agg(F.sort_array(F.collect_list(F.struct("f", "t"))).alias("t"))
    # sizes that differ by 2 % make a class, so these are at most some 1,100 rows
    lows = torn.groupBy(size_class(F.col("n")).alias("c")).agg(F.min("n").alias("low"))
    near = F.explode(F.sequence(size_class(F.ceil(F.col("n") * least - 1e-9)), size_class(F.floor(F.col("n") / least + 1e-9))))
    shown = shared.withColumn("own", size_class(F.col("n"))).withColumn("c", near).join(F.broadcast(lows), "c")
    need = _overlap(least, F.col("n"), F.greatest("low", F.ceil(F.col("n") * least - 1e-9)))
    shown = shown.withColumn("alone", F.col("n") - F.size("t")).withColumn("show", (F.col("n") - need + 1 - F.col("alone")).cast("int")).where("show > 0")
    shown = shown.select("id", "root", "fame", "n", "own", "c", "alone", F.posexplode(F.slice("t", F.lit(1), F.col("show"))).alias("at", "x"))
    keys = F.xxhash64("x.t", F.least("own", "c"), F.greatest("own", "c")).alias("key")
    return written(shown.select(keys, "id", "root", "fame", "n", "own", "c", (F.col("n") - F.col("alone") - F.col("at")).alias("left")), "prefixes")


def _mixed(shown: DataFrame) -> DataFrame:
    """The rows of keys under which two of different roots face each other, written.

    Under most keys that roots share, all rows are of one class and wait for partners of another that nobody there has.
    """
    mixed = shown.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("own").alias("least"), F.max("own").alias("most"), F.max(F.col("own") == F.col("c")).alias("alike"))
    mixed = mixed.where("low <> high and (least <> most or alike)").select(F.col("key").alias("k"))
    return written(shown.join(fitting(written(mixed, "mixed")), F.col("key") == F.col("k")).drop("k"), "met")


def _facing(met: DataFrame, few: DataFrame, least: float) -> DataFrame:
    """(a, b, ra, rb), written: the pairs of a row of ``met`` and one of ``few`` of another root that can reach ``least``."""
    few = few.select(*[F.col(c).alias(f"{c}_x") for c in met.columns])
    facing = (F.col("key") == F.col("key_x")) & (F.col("own") == F.col("c_x")) & (F.col("c") == F.col("own_x"))
    can = F.least("left", "left_x") >= _overlap(least, F.col("n"), F.col("n_x"))
    cross = met.join(few, facing & (F.col("root") != F.col("root_x")) & can)
    swap = F.col("id") < F.col("id_x")
    ends = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("a", "id", "id_x"), ("b", "id_x", "id"), ("ra", "root", "root_x"), ("rb", "root_x", "root"))]
    return written(cross.select(*ends).distinct(), "pairs")


def _outside(met: DataFrame) -> DataFrame:
    """The rows outside their key's largest root."""
    top = met.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"))
    top = fitting(written(top.select(F.col("key").alias("k"), F.col("top.root").alias("main")), "main"))
    return met.join(top, (F.col("key") == F.col("k")) & (F.col("root") != F.col("main"))).select(*met.columns)


def _led(met: DataFrame, least: float) -> DataFrame:
    """Pairs of one document outside each key's largest root, that of most fame, with others: at most one for each row."""
    own = ("key", "own", "c")
    first = _outside(met).groupBy(*own).agg(F.max(F.struct("fame", (-F.col("id")).alias("less"), *[c for c in met.columns if c not in own and c != "fame"])).alias("x"))
    return _facing(met, first.select(*[c if c in own else f"x.{c}" for c in met.columns]), least)


def _crossed(met: DataFrame, least: float) -> DataFrame:
    """All pairs of two roots: of the rows outside a key's largest root with all others."""
    return _facing(met, _outside(met), least)


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weighted: bool = True, least: float = SIMILARITY) -> DataFrame:
    """One row for each document: id, class_id (the least id of its class), class_size, kept (it is that id).

    Classes are connected by pairs of a similarity of ``least`` or more over shingles of five words, each of which
    weighs as often as it occurs (``weighted``) or 1.  Documents with the same shingles are one node.  In a bucket (a
    band's value) all are compared with the one that shares buckets with most others.  Where that leaves the others in several components, their rare
    shingles make keys (``_prefixes``); in keys of several components all are compared with one outside the largest, and
    then, in those still mixed, all of two components with each other.  Each pair that shares a bucket is thus
    compared, already in one class, or proved to be below ``least``, and next to no pair inside a class is made.

    Texts without a word (null, empty, blank) are classes of their own.  An id that comes with several texts is one
    document, near whatever one of them is near; its rows share a class.  Null ids come back as classes of their own,
    with null.  An empty table gives no rows.
    """
    sig = signatures(docs, id_col, text_col, weighted)
    some = sig.where("n > 0")
    node = written(some.groupBy("same", "same2", "n").agg(F.min("id").alias("node")), "nodes")
    member = written(some.select("id", "same", "same2", "n").join(node, ["same", "same2", "n"]).select("id", "node"), "named")
    twice = member.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select(F.col("id").alias("twice"), "a")
    twice = member.join(twice, F.col("id") == F.col("twice")).select("a", F.col("node").alias("b")).distinct()

    reps = some.join(node.select(F.col("node").alias("id")), "id", "left_semi").select("id", "n", "bands").dropDuplicates(["id", "n", "bands"])
    rows = reps.select("id", "n", F.explode("bands").alias("band"))
    rows = written(rows, "bands")
    sizes = rows.groupBy(F.col("band").alias("b")).agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    rows = written(rows.join(sizes, F.col("band") == F.col("b")).select("id", "n", "band", "m"), "shared")
    fame = rows.groupBy(F.col("id").alias("i")).agg(F.sum("m").alias("fame"))  # with whom it shares buckets: a text in the midst of its copies, most
    rows = written(rows.join(fame, F.col("id") == F.col("i")).select("id", "n", "band", "fame"), "shared")
    heads = rows.groupBy(F.col("band").alias("hb")).agg(F.max(F.struct("fame", (-F.col("id")).alias("less"), "id", "n")).alias("head"))
    heads = heads.select("hb", F.col("head.id").alias("head"), F.col("head.n").alias("head_n"))
    members = written(rows.join(heads, F.col("band") == F.col("hb")).where("id <> head").select("id", "n", "band", "fame", "head", "head_n"), "members")
    ids = written(members.select("id").union(members.select("head")).distinct(), "asked")
    sets = shingle_sets(docs, ids, id_col, text_col, weighted)
    sizes = F.least("n", "head_n") >= F.greatest("n", "head_n") * least - 1e-9
    pairs = members.where(sizes).select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    comp = components(similar(pairs, sets, least).union(twice))

    # buckets that are still in pieces
    of = members.join(comp, members["id"] == comp["node"], "left").select("id", "band", "fame", F.coalesce("root", "id").alias("root"))
    of = written(of, "pieces")
    broken = of.groupBy(F.col("band").alias("b")).agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("b")
    torn = of.join(fitting(written(broken, "broken")), F.col("band") == F.col("b"), "left_semi").select("id", "root", "fame").distinct()
    torn = written(torn.join(sets.where("n > 0"), "id").select("id", "root", "fame", "n", F.xxhash64("s").alias("set"), "s"), "torn")
    met, found = _mixed(_prefixes(torn, least)), None
    for round_ in range(LED + 1):
        pairs = _led(met, least) if round_ < LED else _crossed(met, least)
        more = similar(pairs, sets, least).select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        found = more if found is None else found.union(more)
        if round_ < LED and not more.isEmpty():
            now = components(more).select(F.col("node").alias("c_node"), F.col("root").alias("now"))
            met = met.join(now, F.col("root") == F.col("c_node"), "left").withColumn("root", F.coalesce("now", "root")).drop("now", "c_node")
            met = _mixed(written(met, "joined"))

    comp = comp.select(F.col("node").alias("c_node"), "root")
    classes = member.join(comp, member["node"] == comp["c_node"], "left").select("id", F.coalesce("root", "node").alias("class_id"))
    if not found.isEmpty():
        joined = components(found).select(F.col("node").alias("c_node"), "root")
        classes = classes.join(joined, F.col("class_id") == F.col("c_node"), "left").select("id", F.coalesce("root", "class_id").alias("class_id"))
    classes = written(classes, "classes")
    blank = written(sig.where("n = 0").select(F.col("id").alias("blank")), "blank")
    known = written(only_ids(classes, blank.select(F.col("blank").alias("id")).distinct(), "id").distinct(), "known")  # of ids with other texts
    blank = blank.join(fitting(known), F.col("blank") == F.col("id"), "left").select("blank", F.coalesce("class_id", "blank"))
    classes = classes.union(blank)
    size = classes.distinct().groupBy(F.col("class_id").alias("c")).agg(F.count(F.lit(1)).alias("class_size"))
    out = classes.join(size.where("class_size > 1"), F.col("class_id") == F.col("c"), "left")
    out = out.select("id", "class_id", F.coalesce("class_size", F.lit(1)).alias("class_size"), (F.col("id") == F.col("class_id")).alias("kept"))
    nulls = docs.where(F.col(id_col).isNull()).select(F.lit(None).cast("long"), F.lit(None).cast("long"), F.lit(1).cast("long"), F.lit(True))
    return out.union(nulls).withColumnRenamed("id", id_col)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each class, all its columns untouched.

    A document is an id: where the one that stays has several rows, all of them stay.  Rows without an id stay.
    """
    gone = written(near_classes(docs, id_col, text_col).where("not kept").select(id_col).distinct(), "gone")
    return without_ids(docs, gone, id_col)
