"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import release, ship, tidy, written

#: n-grams of 1 to 3 characters go to so many features by a hash.
FEATURES = 1 << 15
#: Documents of each language that the weights are fitted on, about and at most 1.5 times; document frequencies and
#: languages are counted over all.
FIT_DOCS = 1500
#: Scale of term frequencies (a feature's share of a text's n-grams).
SCALE = 100.0
UNKNOWN = "und"
#: A text is kept where its language is likelier by so much than one drawn at random from those learned.
LEAST = 1.2
#: Characters that are scored at a time; a longer text is scored alone.
SLICE = 1 << 18

_letters: list[np.ndarray] = []


def _table() -> np.ndarray:
    """For each code point of the basic plane: itself where it is a letter, else a space."""
    if not _letters:
        t = np.full(1 << 16, 32, dtype=np.uint32)
        for c in range(1 << 16):
            if chr(c).isalpha():
                t[c] = c
        _letters.append(t)
    return _letters[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, ends, letters): the hashed n-grams of all texts, where each text's end, and how many letters it has.

    Texts are lower-cased; runs of what is not a letter are one space, in the basic plane and beyond.
    """
    joined = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    ends = np.cumsum([len(x) for x in joined]) if joined else np.zeros(0, np.int64)
    c = np.concatenate(joined) if joined else np.zeros(0, np.uint32)
    high = c >= 1 << 16
    c = np.where(high, c, _table()[np.minimum(c, (1 << 16) - 1)])
    if high.any():
        points, which = np.unique(c[high], return_inverse=True)
        c[high] = np.array([p if chr(p).isalpha() else 32 for p in points.tolist()], np.uint32)[which]
    blank = c == 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[ends[:-1]] = True  # a text's first space
    n = np.cumsum(keep)
    c, ends = c[keep], n[ends - 1] if len(ends) else ends
    blank = c == 32
    seen = np.concatenate(([0], np.cumsum(~blank)))[np.concatenate(([0], ends))]
    starts = np.concatenate(([0], ends[:-1]))
    mul, shift = np.uint32(0x9E3779B1), np.uint32(17)
    h1 = (c + np.uint32(1)) * mul
    h2 = (h1[:-1] ^ (h1[:-1] >> np.uint32(15))) * np.uint32(31) + h1[1:]
    h3 = (h2[:-1] ^ (h2[:-1] >> np.uint32(15))) * np.uint32(31) + h1[2:] if len(c) > 2 else h1[:0]
    # place p of a text has the n-grams that start there and end inside the text
    left = np.repeat(ends, ends - starts) - np.arange(len(c))
    out = np.full((len(c), 3), FEATURES, dtype=np.int32)  # FEATURES: none
    out[:, 0] = np.where(blank, FEATURES, (h1 * mul) >> shift)
    out[: len(h2), 1] = np.where(left[: len(h2)] >= 2, ((h2 + np.uint32(2)) * mul) >> shift, FEATURES)
    out[: len(h3), 2] = np.where(left[: len(h3)] >= 3, ((h3 + np.uint32(3)) * mul) >> shift, FEATURES)
    return out, ends, np.diff(seen)


@dataclass
class Model:
    """Languages in order, the inverse document frequencies, weights (feature x language), biases and temperature."""

    languages: list[str] = field(default_factory=list)
    idf: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    weights: np.ndarray = field(default_factory=lambda: np.zeros((FEATURES, 0)))
    bias: np.ndarray = field(default_factory=lambda: np.zeros(0))
    temperature: float = 1.0

    def table(self) -> np.ndarray:
        """A row for each feature, and one of zeros for none: idf times weights, then a 1 that counts n-grams."""
        t = np.zeros((FEATURES + 1, len(self.languages) + 1), dtype=np.float32)
        t[:-1, :-1] = self.idf[:, None] * self.weights * SCALE
        t[:-1, -1] = 1
        return t

    def predict(self, texts: list[str | None], table: np.ndarray | None = None) -> tuple[list[str], np.ndarray]:
        """The likeliest language of each text and its calibrated probability; UNKNOWN and 0 without a letter."""
        table = self.table() if table is None else table
        langs, scores = [], []
        some = [t or "" for t in texts]
        i = 0
        while i < len(some):
            j, size = i, 0
            while j < len(some) and (j == i or size + len(some[j]) <= SLICE):
                size += len(some[j])
                j += 1
            grams, ends, letters = ngrams(some[i:j])
            starts = np.concatenate(([0], ends[:-1]))
            per = table[grams[:, 0]] + table[grams[:, 1]] + table[grams[:, 2]]
            sums = np.add.reduceat(per, starts, axis=0, dtype=np.float64)
            z = (sums[:, :-1] / np.maximum(sums[:, -1:], 1) + self.bias) / self.temperature
            known = (letters > 0) & bool(self.languages)
            if self.languages:
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                top = z.argmax(axis=1)
                scores.append(np.where(known, p[np.arange(len(p)), top], 0.0))
                langs += [self.languages[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]
            else:
                scores.append(np.zeros(j - i))
                langs += [UNKNOWN] * (j - i)
            i = j
        return langs, np.concatenate(scores) if scores else np.zeros(0)


def _log_loss(z: np.ndarray, y: np.ndarray, t: float) -> float:
    """Of targets that leave each other language the share of one row in all and two more, so that a temperature
    settles where every row is told right."""
    z = z / t
    top = z.max(axis=1, keepdims=True)
    loss = -(z - top - np.log(np.exp(z - top).sum(axis=1, keepdims=True)))
    rest = 1.0 / (len(y) + 2)
    return float(((1 - rest) * loss[np.arange(len(y)), y] + rest * loss.mean(axis=1)).mean())


def fit_ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], languages: list[str], idf: np.ndarray, *, alpha=0.5, beta=1.0, l1=0.002, l2=0.02, passes=4, seed=3) -> Model:
    """Follow the regularised leader over ``rows`` (language, features, counts), then a temperature.

    Each weight has its own rate; ``l1`` keeps weights at zero, ``l2`` small.  Every fifth row is not fitted on: the
    temperature is the one of least log loss there.
    """
    k = len(languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))  # the last row is the bias

    def weights(i):
        return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((beta + np.sqrt(n[i])) / alpha + l2))

    def row(r):  # made anew each time, so that rows are in memory once and as small as they come
        lang, f, c = rows[r]
        return lang, np.append(f, FEATURES), np.append(c / max(1, c.sum()) * idf[f] * SCALE, 1.0)

    rng = np.random.default_rng(seed)
    order = rng.permutation(len(rows))
    held, fit = order[::5], np.array([i for j, i in enumerate(order) if j % 5])
    for _ in range(passes):
        for r in rng.permutation(fit) if len(fit) else []:
            y, i, x = row(r)
            w = weights(i)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[y] -= 1
            g = x[:, None] * p[None, :]
            old = n[i]
            n[i] = old + g * g
            z[i] += g - (np.sqrt(n[i]) - np.sqrt(old)) / alpha * w
    w = weights(np.arange(FEATURES + 1))
    temperature = 1.0
    if len(held):
        s = np.stack([x @ w[i] for _, i, x in map(row, held)])
        y = np.array([rows[r][0] for r in held])
        lo, hi = math.log(0.05), math.log(20.0)
        for _ in range(60):  # the loss has one least value along the temperature
            a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
            lo, hi = (lo, b) if _log_loss(s, y, math.exp(a)) <= _log_loss(s, y, math.exp(b)) else (a, hi)
        temperature = math.exp((lo + hi) / 2)
    return Model(languages, idf, w[:-1], w[-1], temperature)


def train(labelled: DataFrame, text_col: str, lang_col: str, id_col: str, fit_docs: int = FIT_DOCS) -> Model:
    """Fits a model on rows with a text and a language.

    One pass over all of them counts document frequencies, and returns the features of a sample by a hash of the id
    whose rate is set by each language's count.  The driver gets FEATURES counts and the sample's features.
    """
    ship(labelled.sparkSession)
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).agg(F.count(F.lit(1))).collect()}
    languages = sorted(counts)
    if not languages:
        return Model()
    rates = F.create_map(*[F.lit(x) for k in languages for x in (k, min(1.0, fit_docs / counts[k]) * (1 << 30))])
    chosen = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1 << 30)) < rates[F.col(lang_col)]
    rows = rows.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), chosen.alias("chosen"))

    def work(batches):
        seen, flags, docs = np.zeros(FEATURES + 1, np.int64), np.zeros(FEATURES + 1, np.uint8), 0
        for b in batches:
            langs, picked = b.column("lang").to_pylist(), b.column("chosen").to_pylist()
            texts, i = b.column("text").to_pylist(), 0
            while i < len(texts):
                j, size = i, 0
                while j < len(texts) and (j == i or size + len(texts[j]) <= SLICE):
                    size += len(texts[j])
                    j += 1
                grams, ends, _ = ngrams(texts[i:j])
                a = 0
                for k, z in enumerate(ends.tolist(), i):
                    own = grams[a:z].reshape(-1)
                    flags.fill(0)
                    flags[own] = 1
                    seen += flags
                    if picked[k]:
                        per = np.bincount(own, minlength=FEATURES + 1)[:-1]
                        f = np.flatnonzero(per)
                        yield pa.record_batch({"lang": [langs[k]], "features": pa.array([f.astype("<i4").tobytes()], pa.binary()), "counts": pa.array([per[f].astype("<i4").tobytes()], pa.binary())})
                    a = z
                docs += j - i
                i = j
        f = np.flatnonzero(seen[:-1])
        yield pa.record_batch({"lang": pa.array([None], pa.string()), "features": pa.array([f.astype("<i4").tobytes()], pa.binary()), "counts": pa.array([seen[f].astype("<i4").tobytes()], pa.binary())})

    out = written(rows.mapInArrow(tidy(work), "lang string, features binary, counts binary"), "features")
    sample = [(languages.index(r.lang), np.frombuffer(r.features, "<i4"), np.frombuffer(r.counts, "<i4")) for r in out.where("lang is not null").orderBy("lang", "features", "counts").collect()]

    def spread(batches):
        for b in batches:
            for f, c in zip(b.column("features").to_pylist(), b.column("counts").to_pylist(), strict=True):
                yield pa.record_batch({"f": pa.array(np.frombuffer(f, "<i4")), "n": pa.array(np.frombuffer(c, "<i4").astype(np.int64))})

    df = np.zeros(FEATURES)
    for r in out.where("lang is null").select("features", "counts").mapInArrow(tidy(spread), "f int, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():
        df[r.f] = r.n
    idf = np.log((1 + sum(counts.values())) / (1 + df)) + 0.1
    model = fit_ftrl(sample, languages, idf)
    del sample
    release()
    return model


def predict(docs: DataFrame, model: Model, text_col: str = "text", lang_name: str = "lang_pred", score_name: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its probability, from the text alone."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES x languages numbers

    def work(batches):
        m = shared.value
        table = m.table()
        for b in batches:
            lang, score = m.predict(b.column(text_col).to_pylist(), table)
            yield pa.record_batch([*b.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*b.schema.names, lang_name, score_name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(tidy(work), f"{fields}, {lang_name} string, {score_name} double")


def held_out(id_col: str) -> Column:
    return (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % 4) == 2


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_docs: int = FIT_DOCS) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, lang_pred, score.

    It learns from rows that are not held out and have a text and a language; prediction sees the text only.  Null
    texts and texts without a letter are UNKNOWN with score 0, as is every text where nothing could be learned.
    """
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col, fit_docs)
    rows = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return predict(rows, model).drop("text").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least: float = LEAST) -> DataFrame:
    """``docs`` less the rows rejected: null texts, those without a letter, and scores under ``least`` over the number
    of languages (where that is more than one): texts that are like none of them.

    All columns stay untouched, repeated rows and null ids are judged like others, and an empty table stays empty.
    Where nothing could be learned, for want of a language in any row, only texts without a letter go.
    """
    model = train(docs.where(~held_out(id_col)), text_col, lang_col, id_col)
    if not model.languages:
        return docs.where(F.regexp_like(text_col, F.lit(r"\p{L}")))
    judged = predict(docs, model, text_col, "__cs_lang", "__cs_score")
    return judged.where((F.col("__cs_lang") != UNKNOWN) & (F.col("__cs_score") >= (least / len(model.languages) if len(model.languages) > 1 else 0.0))).select(*docs.columns)
