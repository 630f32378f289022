"""Token ids of whole texts, each distinct word encoded once by a worker.

The two tokenizers split a text into pieces before any merge, and no piece crosses the places where this module
cuts.  So the ids of a text are those of its words in turn; tests compare with the library on whole texts.
"""

from __future__ import annotations

import os
import re
import string
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces of words that a worker remembers; beyond, those it has not met since the last time are forgotten.
REMEMBERED = 100_000
#: Bytes of text that are split at a time.
SLICE = 4 << 20
#: Texts in which a space is not always the start of a word: they are encoded whole.
_WHOLE = r"[\t\r\f\v\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]|[ \n] [ \n]|^ |<\|"
#: Letters of which words go to the model as they are: of ASCII, Latin-1 and Latin Extended-A, but for the one with a two-part lower case.
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f]+")

_MARKS = frozenset(string.punctuation)

_kept: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's own encoder for a tokenizer file."""
    if path not in _kept:
        _kept[path] = WordEncoder(path)
    return _kept[path]


class WordEncoder:
    """Encodes Arrow string arrays.  ``lower``: the tokenizer drops white space and case, else a word keeps its space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.model._resize_cache(0)
        # a normaliser that lower-cases goes with one that drops white space in the files this module knows
        self.lower = self.tok.normalizer is not None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        # the letters that stand for bytes in byte-level vocabularies
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelt = dict(zip(own, own, strict=True)) | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in own)}
        self.space = chr(self.spelt[32])
        self.direct = self._direct()

    def _spell(self, w: str) -> str:
        if w.isascii():
            return self.space + w[1:] if w[:1] == " " else w
        return w.encode().decode("latin-1").translate(self.spelt)

    def _direct(self) -> bool:
        """Whether a word of ``_LETTERS`` alone reaches the model as one piece and in this spelling, so that the steps before can be left out."""
        letters = "".join(filter(_LETTERS.fullmatch, map(chr, range(0x180))))
        w = letters.lower() if self.lower else f" {letters}"
        if any(_LETTERS.fullmatch(t.content.strip()) for t in self.tok.get_added_tokens_decoder().values()):
            return False
        if getattr(self.tok.model, "dropout", None) or self.tok.pre_tokenizer is None or self.lower and self.tok.normalizer.normalize_str(letters) != w:
            return False
        return all([p for p, _ in self.tok.pre_tokenizer.pre_tokenize_str(x)] == [self._spell(x)] for x in {w, w.strip(), w[:27], w[:27].strip()})

    def _plain(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _parts(self, w: str) -> list[str]:
        """Pieces of a word that are encoded apart and of which most are known."""
        if self.lower:
            if "<|" in w:  # special tokens are spelt in lower case only
                return [w]
            if "\n" in w:
                return [p for x in w.split("\n") if x for p in self._parts(x)]
            if w.isascii() or _LETTERS.fullmatch(w):
                w = w.lower()
        elif w.count("\n") == 1 and w[0] != "\n" and w[-1] != "\n" and w != " \n":
            a, b = w.split("\n")
            if a != " ":
                return [*self._parts(a), "\n", *self._parts(b)]
        if w[-1:].isalpha():
            return [w]
        word = w.rstrip(string.punctuation)
        # a letter whose lower case is a letter and a mark joins what follows
        if len(word) < len(w) and word[-1:].lower().isalpha():
            return [word.lower() if self.lower and _LETTERS.fullmatch(word) else word, w[len(word) :]]
        return [w]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, remembered by its pieces.  Those of letters alone go straight to the model, as what the
        library does before takes longer; words with others wait until the library has had all of these together.
        """
        known, old, lower, model = self.known, self.old, self.lower, self.tok.model.tokenize
        coded = [known.get(w) for w in words]
        rest: dict[str, None] = {}
        late: list[tuple[int, list[str]]] = []
        for i, w in enumerate(words):
            if coded[i] is not None:
                continue
            if w in old:
                known[w] = coded[i] = old[w]
                continue
            # what _parts gives for a word of ASCII letters with or without one mark behind it, which most of these are
            if lower and w.isascii() and w[:-1].isalpha() and (w[-1].isalpha() or w[-1] in _MARKS):
                ps = [w.lower()] if w[-1].isalpha() else [w[:-1].lower(), w[-1]]
            elif not lower and w[1:].isalpha():
                ps = [w]
            else:
                ps = self._parts(w)
            raw = []
            for p in ps:
                v = known.get(p)
                if v is None:
                    v = old.get(p)
                    if v is None and self.direct:
                        x = p if lower or p[:1] != " " else p[1:]
                        if x.isalpha() and (x.isascii() or _LETTERS.fullmatch(x)):
                            v = array("I", [t.id for t in model(self._spell(p))]).tobytes()
                    if v is None:
                        rest[p] = None
                    else:
                        known[p] = v
                raw.append(v)
            if None in raw:
                late.append((i, ps))
            else:
                coded[i] = raw[0] if len(raw) == 1 else b"".join(raw)
        pieces = list(rest)
        for i in range(0, len(pieces), 20_000):
            known.update(zip(pieces[i : i + 20_000], self._plain(pieces[i : i + 20_000]), strict=True))
        for i, ps in late:
            coded[i] = b"".join([known[p] for p in ps])
        return coded

    def _slice(self, texts: pa.Array, block: int | None):
        """Yields (first row, ids end to end, how many each text has) for texts of ``block`` ids in all, or one text.

        Each distinct word of the slice is looked up once; ids, of which there are more, are laid out block by block.
        """
        if len(self.known) > REMEMBERED:
            self.known, self.old = {}, self.known
        n = len(texts)
        odd = np.zeros(n, bool) if self.lower else pc.match_substring_regex(texts, _WHOLE).to_numpy(zero_copy_only=False)
        lists = pc.split_pattern(texts, " ")
        at = lists.offsets.to_numpy().astype(np.int64)
        enc = lists.values.slice(at[0], at[-1] - at[0]).dictionary_encode()
        at = at - at[0]
        del lists
        index = enc.indices.to_numpy()
        words = enc.dictionary.to_numpy(zero_copy_only=False).tolist()
        del enc
        # places among a slice's words and ids; only one text of half a GB needs wider ones
        kind = np.int32 if (pc.sum(pc.binary_length(texts)).as_py() or 0) < 1 << 29 else np.int64
        if self.lower:
            coded = self._words(words)
        else:
            first, where = np.unique(index[at[:-1]], return_inverse=True)
            index = index.astype(kind)
            index[at[:-1]] = len(words) + where
            coded = self._words([f" {w}" for w in words]) + self._words([words[i] for i in first])
        del words
        ids, lens = np.frombuffer(b"".join(coded), "<u4"), np.fromiter(map(len, coded), kind, len(coded)) // 4
        del coded
        starts = np.cumsum(lens, dtype=kind) - lens
        # ids before each text; sums of the words' own are made again for each block
        edge = np.concatenate(([0], np.cumsum(lens[index], dtype=np.int64)))[at]
        i = 0
        while i < n:
            j = n if block is None else max(i + 1, int(np.searchsorted(edge, edge[i] + block, side="right")) - 1)
            own = index[at[i] : at[j]]
            each = lens[own]
            place = np.repeat(starts[own] - (np.cumsum(each, dtype=kind) - each), each)
            place += np.arange(len(place), dtype=kind)
            out, counts = ids[place], np.diff(edge[i : j + 1])
            del own, each, place
            if odd[i:j].any():
                pieces = np.split(out, np.cumsum(counts)[:-1])
                for k, raw in zip(np.flatnonzero(odd[i:j]), self._plain(texts.slice(i, j - i).filter(pa.array(odd[i:j])).to_pylist()), strict=True):
                    pieces[k] = np.frombuffer(raw, "<u4")
                out, counts = np.concatenate(pieces), np.fromiter(map(len, pieces), np.int64, j - i)
            yield i, out, counts
            i = j

    def encode(self, texts: pa.Array, size: int | None = None, block: int | None = None):
        """Yields (first row, ids, counts) for slices of ``texts`` of ``size`` bytes (``SLICE``); null counts as empty.

        With ``block``, a slice comes in parts of so many ids, or of one text.
        """
        if not (pa.types.is_string(texts.type) or pa.types.is_large_string(texts.type)):
            texts = texts.cast(pa.large_string())
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        i, n = 0, len(texts)
        while i < n:
            seen = sizes[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(sizes, seen + (size or SLICE), side="right")))
            for k, ids, counts in self._slice(pc.fill_null(texts.slice(i, j - i), ""), block):
                yield i + k, ids, counts
            i = j


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end`` after each text."""
    n, edge = len(counts), np.cumsum(counts)
    out = np.insert(ids, edge, end) if n else ids
    return out.astype("<u4", copy=False), np.concatenate(([0], edge + np.arange(1, n + 1)))


