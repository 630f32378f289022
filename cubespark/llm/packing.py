"""Best-fit packing of token sequences, improved by swaps between underfull bins."""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, slots, tidy, written
from .encode import encoder, with_end

SEQUENCE = 4096
#: Bytes of text that are split at a time, and ids that are laid out at a time: less memory than the encoder's own.
SLICE, BLOCK = 1 << 20, 1 << 18
#: Bytes of text that go to a Python worker at a time.
BATCH = 4 << 20
#: Rounds of the local search over the underfull bins; a round without a gain ends it.
ROUNDS = 50


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, crc): each document's ids with ``end_id`` after them, cut every ``size`` tokens."""
    ship(docs.sparkSession)

    def work(batches):
        enc = encoder(tokenizer)
        for b in batches:
            names = b.column("id")
            for i, ids, counts in enc.encode(b.column("text"), SLICE, BLOCK):
                ids, edge = with_end(ids, counts, end_id)
                lens = np.diff(edge)
                n = -(-lens // size)
                doc = np.repeat(np.arange(len(lens)), n)
                piece = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                start = piece * size
                length = np.minimum(size, lens[doc] - start)
                at = edge[doc] + start
                crc = [zlib.crc32(ids[a:z]) for a, z in zip(at.tolist(), (at + length).tolist(), strict=True)]
                yield pa.record_batch({"id": names.take(pa.array(doc + i)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "crc": pa.array(crc, pa.int64())})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return written(rows.mapInArrow(tidy(work), "id long, piece int, start long, length long, crc long"), "pieces", BATCH)


class Bins:
    """Groups of bins with the same content: content (a sorted tuple of (length, times)), how many, and what is left."""

    def __init__(self, size: int):
        self.size = size
        self.groups: dict[int, list] = {}  # id: [content, bins, residual]
        self.by_residual: dict[int, list[int]] = {}
        self.mask = 0
        self.next = 0

    def add(self, content: tuple, bins: int) -> int:
        left = self.size - sum(n * k for n, k in content)
        g, self.next = self.next, self.next + 1
        self.groups[g] = [content, bins, left]
        self.by_residual.setdefault(left, []).append(g)
        self.mask |= 1 << left
        return g

    def take(self, g: int, bins: int) -> tuple:
        """Removes so many bins of a group; their content."""
        content, n, left = self.groups[g]
        if n > bins:
            self.groups[g][1] = n - bins
            return content
        del self.groups[g]
        same = self.by_residual[left]
        same.remove(g)
        if not same:
            del self.by_residual[left]
            self.mask &= ~(1 << left)
        return content

    def best_fit(self, length: int) -> int | None:
        """The group with the least residual of at least ``length``."""
        m = self.mask >> length
        if not m:
            return None
        r = (m & -m).bit_length() - 1 + length
        return self.by_residual[r][0]


def plus(content: tuple, length: int, times: int) -> tuple:
    """``content`` with a length more (or less) often."""
    d = dict(content)
    d[length] = d.get(length, 0) + times
    return tuple(sorted((n, k) for n, k in d.items() if k))


def best_fit_decreasing(counts: dict[int, int], size: int = SEQUENCE) -> Bins:
    """Best fit of the lengths from the longest, all pieces of a length at once: equal bins stay one group.

    A length adds three groups at most, so their number is bounded by the lengths, not by the documents.
    """
    bins = Bins(size)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            g = bins.best_fit(length)
            if g is None:
                per = size // length
                whole, rest = divmod(left, per)
                if whole:
                    bins.add(((length, per),), whole)
                if rest:
                    bins.add(((length, rest),), 1)
                break
            _, n, room = bins.groups[g]
            per = room // length
            whole, rest = min(divmod(left, per), (n, 0))
            if whole:
                bins.add(plus(bins.take(g, whole), length, per), whole)
                left -= whole * per
            elif rest:
                bins.add(plus(bins.take(g, 1), length, rest), 1)
                left -= rest
    return bins


def local_search(bins: Bins, rounds: int = ROUNDS) -> Bins:
    """Empties underfull bins: moves and exchanges that increase the sum of squared fills.

    In each round the emptiest groups, in turn, give their documents away: a document moves to the bin that it fills
    best; else it is exchanged for a shorter one there, or for two shorter ones, where the other bin gets fuller.
    Moves take as many bins at once as both groups have.  A fuller bin gains more square than the emptier loses.
    """
    for _ in range(rounds):
        gain = False
        under = sorted((g for g, x in bins.groups.items() if x[2] > 0), key=lambda g: -bins.groups[g][2])
        for g in under:
            while g in bins.groups and bins.groups[g][2] > 0:
                nxt = _improve(bins, g)
                if nxt is None:
                    break
                gain, g = True, nxt
        if not gain:
            break
    return bins


def _improve(bins: Bins, g: int) -> int | None:
    """One move out of group ``g``; the group that remains of it (-1: its bins are empty), or None without a gain."""
    content, n, room = bins.groups[g]
    fill = bins.size - room
    others = sorted(r for r in bins.by_residual if 0 < r <= room)
    for length, _ in sorted(content, reverse=True):
        at = bisect_left(others, length)
        for r in others[at:]:  # a move: into the tightest bin that is at least as full
            for h in bins.by_residual[r]:
                if h != g and bins.size - r >= fill - length:
                    return _shift(bins, g, h, [length], [])
    for length, _ in sorted(content, reverse=True):
        for r in others:
            for h in bins.by_residual[r]:
                if h == g:
                    continue
                theirs = [x for x, _ in bins.groups[h][0]]
                # theirs of length - r up to length - 1: the nearest to length - r fills that bin best
                i = bisect_left(theirs, length - r)
                if i < len(theirs) and theirs[i] < length:
                    return _shift(bins, g, h, [length], [theirs[i]])
                pair = _pair(bins.groups[h][0], length - r, length)
                if pair:
                    return _shift(bins, g, h, [length], pair)
    return None


def _pair(content: tuple, least: int, below: int) -> list[int] | None:
    """Two lengths of a bin with a sum of at least ``least`` and under ``below``, the smallest such sum."""
    flat = [x for x, k in content for _ in range(min(k, 2))]
    best, i, j = None, 0, len(flat) - 1
    while i < j:
        s = flat[i] + flat[j]
        if s >= least:
            if s < below and (best is None or s < sum(best)):
                best = [flat[i], flat[j]]
            j -= 1
        else:
            i += 1
    return best


def _shift(bins: Bins, g: int, h: int, give: list[int], get: list[int]) -> int:
    """Moves ``give`` from bins of ``g`` to as many of ``h``, and ``get`` back."""
    n = min(bins.groups[g][1], bins.groups[h][1])
    a, b = bins.take(g, n), bins.take(h, n)
    for x in give:
        a, b = plus(a, x, -1), plus(b, x, 1)
    for x in get:
        a, b = plus(a, x, 1), plus(b, x, -1)
    bins.add(b, n)
    return bins.add(a, n) if a else -1


def plan(counts: dict[int, int], size: int = SEQUENCE, rounds: int = ROUNDS) -> tuple[dict[str, np.ndarray], int]:
    """Where the pieces of each length go, by their rank among them, and the number of sequences.

    Entries sorted by (length, rank): the length, its first rank, the first sequence, how often a sequence has it,
    and the place of the first.
    """
    bins = local_search(best_fit_decreasing(counts, size), rounds)
    used, rows, seq = dict.fromkeys(counts, 0), [], 0
    for g in sorted(bins.groups):
        content, n, _ = bins.groups[g]
        place = 0
        for length, times in reversed(content):
            rows.append((length, used[length], seq, times, place))
            used[length] += times * n
            place += length * times
        seq += n
    assert used == dict(counts)
    rows.sort()
    table = np.array(rows, dtype=np.int64).reshape(-1, 5)
    return {k: table[:, i] for i, k in enumerate(("length", "rank", "seq", "times", "place"))}, seq


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Only how many pieces there are of each length (at most ``size`` numbers) reaches the driver, which packs them by
    groups of equal bins; pieces then find their place by their rank in their length.  Null and empty texts are one
    end id; rows that repeat an id are documents of their own; an empty table gives no rows.
    """
    pieces = token_pieces(docs, tokenizer, end_id, size, id_col, text_col)
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table, _ = plan(counts, size)
    ranked = slots(pieces, "length", ["id", "piece"], "rank")
    ship(docs.sparkSession)

    def work(batches):
        key = table["length"] << 40 | table["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            i = np.searchsorted(key, length << 40 | rank, side="right") - 1
            k = rank - table["rank"][i]
            seq, off = table["seq"][i] + k // table["times"][i], table["place"][i] + k % table["times"][i] * length
            yield pa.record_batch({c: b.column(c) for c in ("id", "piece", "start", "length")} | {"ids_crc32": b.column("crc"), "sequence_id": pa.array(seq), "offset": pa.array(off)})

    out = ranked.mapInArrow(tidy(work), "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return out.withColumnRenamed("id", id_col)
