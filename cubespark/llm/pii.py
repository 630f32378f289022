"""Personal data: anchors found by an Aho-Corasick automaton, expanded and checked by local parsers."""

from __future__ import annotations

import hashlib
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ship, tidy

BASE = ("email", "ip", "card", "phone")
#: Kinds that the method adds: numbers after a cue or with a valid IBAN checksum, and URLs with a user in them.
MORE = ("account", "url")
KINDS = BASE + MORE
CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta")

_DIGITS = frozenset(string.digits)
_LABEL = frozenset(string.ascii_letters + string.digits + "-")
_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_PHONE = frozenset(string.digits + " ().-")
_ALNUM = frozenset(string.ascii_letters + string.digits)
_URL = frozenset(string.ascii_letters + string.digits + "-._~:/?#[]@!$&'()*+,;=%")

_kept: list = []


def automaton():
    """Anchors: at-signs, schemes, plus signs and dots beside digits, two digits in a run, cues of accounts."""
    if not _kept:
        import ahocorasick

        a = ahocorasick.Automaton()
        a.add_word("@", "email")
        a.add_word("://", "url")
        for d in string.digits:
            a.add_word(f"+{d}", "phone")
            a.add_word(f"{d}.", "ip")
            for e in string.digits:
                for sep in ("", " ", "-"):
                    a.add_word(f"{d}{sep}{e}", "card")
        for c in CUES:
            for form in (c, c.upper(), c.capitalize()):
                a.add_word(form, "account")
        a.make_automaton()
        _kept.append(a)
    return _kept[0]


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _email(t: str, at: int, free: int):
    """From an at-sign: the local part to the left, then labels with a dot between each two."""
    a = at
    while a > free and t[a - 1] in _LOCAL:
        a -= 1
    n, z = len(t), at + 1
    while z < n and t[z] in _LABEL:
        z += 1
    if a == at or z == at + 1:
        return None
    end = 0
    while z < n and t[z] == ".":
        y = z + 1
        while y < n and t[y] in _LABEL:
            y += 1
        if y == z + 1:
            break
        z = end = y
    return (a, end) if end else None


def _digits(t: str, i: int) -> int:
    n = len(t)
    while i < n and t[i] in _DIGITS:
        i += 1
    return i


def _ip(t: str, a: int, free: int):
    """From a digit before a dot: four runs of digits; (start, end, whether each part is at most 255)."""
    while a > free and t[a - 1] in _DIGITS:
        a -= 1
    parts, i = [], a
    for k in range(4):
        z = _digits(t, i)
        if z == i:
            return None
        parts.append(t[i:z])
        if k < 3:
            if z >= len(t) or t[z] != ".":
                return None
            z += 1
        i = z
    return a, i, all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def _card(t: str, a: int):
    """From the first digit of a run: digits with at most one space or hyphen between each two."""
    n, i = len(t), a + 1
    while i < n:
        if t[i] in _DIGITS:
            i += 1
        elif t[i] in " -" and i + 1 < n and t[i + 1] in _DIGITS:
            i += 2
        else:
            break
    return i


def _phone(t: str, a: int):
    """From a plus sign and a digit."""
    n, i, last = len(t), a + 2, 0
    while i < n and t[i] in _PHONE:
        if t[i] in _DIGITS:
            last = i
        i += 1
    return last + 1 if last > a + 2 else 0


def _account(t: str, z: int):
    """After a cue: a few separators, then an IBAN with a valid checksum or 8 to 20 digits."""
    n, i = len(t), z
    while i < n and i < z + 6 and t[i] in " :#.-=\t":
        i += 1
    j = i
    while j < n and j < i + 45 and (t[j] in _ALNUM or (t[j] == " " and j + 1 < n and t[j + 1] in _ALNUM)):
        j += 1
    raw, ends = "", []
    for k in range(i, j):
        if t[k] != " ":
            raw += t[k]
            ends.append(k + 1)
    up = raw.upper()
    if len(up) >= 15 and up[:2].isalpha() and up[2:4].isdigit():
        for m in range(min(34, len(up)), 14, -1):  # the longest that is valid
            whole = ends[m - 1] == n or t[ends[m - 1]] not in _ALNUM
            if whole and int("".join(str(int(c, 36)) for c in up[4:m] + up[:4])) % 97 == 1:
                return i, ends[m - 1]
    d = _digits(t, i)
    return (i, d) if 8 <= d - i <= 20 and (d == n or t[d] not in _ALNUM) else None


def _url(t: str, at: int):
    """Around ``://``: a scheme to the left, and an authority with a user in it to the right."""
    a = at
    while a > 0 and at - a < 32 and t[a - 1] in _ALNUM:
        a -= 1
    n, y = len(t), at + 3
    while y < n and t[y] in _URL and t[y] not in "/?#":  # not past the next scheme: each character is looked at twice at most
        y += 1
    user, sep, host = t[at + 3 : y].rpartition("@")
    if a == at or not t[a].isalpha() or not sep or not user or not host:
        return None
    z = y
    while z < n and t[z] in _URL:
        z += 1
    while t[z - 1] in ".,;:!?)'":
        z -= 1
    return a, z


def find(text: str | None) -> dict[str, list[tuple[int, int]]]:
    """Spans (code points, end exclusive) by kind, in order; spans of a kind do not overlap."""
    t = text or ""
    out: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # of a kind: where its last match ended
    for end, kind in automaton().iter(t):
        if kind == "card":
            a = end - 1 if t[end - 1] in _DIGITS else end - 2
            if a < free[kind]:
                continue
            # the anchor is the first pair of the run, as later pairs of it are not free
            z = _card(t, a)
            free[kind] = z
            digits = "".join(c for c in t[a:z] if c in _DIGITS)
            if 14 <= len(digits) <= 19 and _luhn(digits):
                out[kind].append((a, z))
        elif kind == "email":
            if end >= free[kind] and (m := _email(t, end, free[kind])):
                out[kind].append(m)
                free[kind] = m[1]
        elif kind == "ip":
            if end - 1 >= free[kind] and (m := _ip(t, end - 1, free[kind])):
                free[kind] = m[1]
                if m[2]:
                    out[kind].append(m[:2])
        elif kind == "phone":
            a = end - 1
            if a >= free[kind] and (z := _phone(t, a)):
                free[kind] = z
                if 10 <= sum(c in _DIGITS for c in t[a:z]) <= 15:
                    out[kind].append((a, z))
        elif kind == "account":
            a = end + 1
            if a >= free[kind] and (m := _account(t, a)):
                out[kind].append(m)
                free[kind] = m[1]
        elif end - 2 >= free[kind] and (m := _url(t, end - 2)):
            out[kind].append(m)
            free[kind] = m[1]
    return out


def listed(spans: dict[str, list[tuple[int, int]]], kinds=KINDS) -> str:
    """``kind:start:end``, by start and then the kinds' order."""
    rows = sorted((a, i, z, k) for i, k in enumerate(kinds) for a, z in spans[k])
    return ",".join(f"{k}:{a}:{z}" for a, _, z, k in rows)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Whole texts are read, in time that grows as their length; null counts as empty and has no spans.  ``spans`` also
    has the kinds that the method adds.  Rows that repeat an id, and null ids, have rows of their own; an empty table
    gives none.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def work(batches):
        for b in batches:
            found = [find(t) for t in b.column("text").to_pylist()]
            cols = {"id": b.column("id")} | {f"n_{k}": pa.array([len(f[k]) for f in found], pa.int64()) for k in BASE}
            cols["base_sha256"] = pa.array([hashlib.sha256(listed(f, BASE).encode()).hexdigest() for f in found], pa.string())
            cols["spans"] = pa.array([listed(f) for f in found], pa.string())
            yield pa.record_batch(cols)

    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string"
    return rows.mapInArrow(tidy(work), schema).withColumnRenamed("id", id_col)
