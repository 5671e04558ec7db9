"""Garbled text from wrong character encoding (problem 10).

Adjacent character pairs are scored by their mutual information in the whole corpus, maximum-scoring segments isolate
improbable runs, and only inside these runs inverse mappings (bytes of the wrong encoding read again in the right one)
are tried. A reading is taken if the corpus finds its pairs likelier than those it replaces.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.counts import Table, pruned, tallied

#: Counts are exact; pairs that make up less than this share of all pairs are taken as unseen, so there are two million
#: others at most, whatever the corpus.
SHARE = 5e-7
#: Frequencies are compared per so many pairs, so the thresholds mean the same at every size.
PER = 4e6
_BITS = 21
#: A pair's information counts in full only if it is much more frequent than this share of all pairs.
RARE = 2e-5
#: A pair under this many bits is improbable.
BITS = 1.0
MAX_ROUNDS = 3

_WRONG = ("sloppy", "mac_roman", "cp850", "cp437", "cp949", "iso8859_15")
#: Hangul that UTF-8 of two bytes gives when it is read as cp949; UTF-8 of three bytes gives Hanja too.
_FROM_TWO = "".join(ch for a in range(0xC2, 0xE0) for b in range(0x80, 0xC0) if "가" <= (ch := bytes([a, b]).decode("cp949", "replace")) <= "힣")
#: Stretches of it that may be such a reading: all the Hangul of a place, or what follows a Latin letter.
_AS_HANGUL = re.compile(f"(?<![가-힣])[{_FROM_TWO}]+(?![가-힣])|(?<=[A-Za-zÀ-ſ])[{_FROM_TWO}]+")
_LOST = re.compile("�")
_C1 = re.compile("[\x80-\x84\x86-\x9f]")


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)


def pair_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a << _BITS) | b


def _count(batches):
    def keys():
        for pdf in batches:
            c = codes_of("\n\n".join(pdf["text"]))
            if len(c) > 1:
                yield pair_key(c[:-1], c[1:])

    yield from tallied(keys())


class Pairs:
    """Pair and character counts of the corpus."""

    def __init__(self, pairs: np.ndarray, n_pairs: np.ndarray, chars: np.ndarray, n_chars: np.ndarray):
        self.pairs, self.total, self.seen = Table(pairs, n_pairs), max(1.0, float(np.sum(n_chars))), (chars, np.asarray(n_chars, dtype=np.float32))
        self._lay()

    def _lay(self):
        self.chars = np.zeros(1 << _BITS, dtype=np.float32)
        self.chars[self.seen[0]] = self.seen[1]
        self.read: dict[tuple, tuple | None] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("chars", "read")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._lay()

    def information(self, c: np.ndarray) -> np.ndarray:
        """Mutual information of each adjacent pair in bits, shrunk towards 0 for pairs that are rare in the corpus."""
        n = self.pairs.get(pair_key(c[:-1], c[1:])).astype(np.float64)
        e = (self.chars[c[:-1]] + 1.0) * (self.chars[c[1:]] + 1.0) / self.total
        return np.log2((n + 0.1) / e) * n / (n + RARE * self.total)

    def rate(self, text: str) -> float:
        """Mean log2 of the pairs' frequencies."""
        c = codes_of(text)
        return float(np.log2(self.pairs.get(pair_key(c[:-1], c[1:])) * (PER / max(self.total, PER)) + 0.5).mean()) if len(c) > 1 else 0.0


def statistics(texts: DataFrame) -> Pairs:
    """Counts over all texts. The driver gets a row per frequent pair, 1 / SHARE at most, and one per character."""
    n = texts.where(F.col("text").isNotNull()).select("text").mapInPandas(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).persist()
    chars = n.groupBy(F.shiftright("key", _BITS).alias("c")).agg(F.sum("n").alias("n")).toPandas()
    pairs = pruned(n, float(chars["n"].sum()), SHARE)
    n.unpersist()
    return Pairs(pairs["key"].to_numpy(dtype=np.int64), pairs["n"].to_numpy(), chars["c"].to_numpy(dtype=np.int64), chars["n"].to_numpy(dtype=np.float64))


def segments(score: np.ndarray) -> list[tuple[int, int]]:
    """All maximal segments [s, e) of positive score: disjoint, and none can be widened without loss."""
    if not len(score):
        return []
    # Neighbours of one sign always stay together, so they enter as one.
    begins = np.flatnonzero(np.concatenate([[True], (score[1:] > 0) != (score[:-1] > 0)]))
    ends = np.append(begins[1:], len(score)).tolist()
    stack: list[tuple[int, int, float, float]] = []  # begin, end, sum before, sum with
    done: list[tuple[int, int]] = []
    total = 0.0
    for i, end, x in zip(begins.tolist(), ends, np.add.reduceat(score, begins).tolist()):
        if x <= 0:
            total += x
            continue
        s, left = i, total
        total += x
        while True:
            # Segments that begin no lower than this one can't be joined with it or with any later one.
            while stack and stack[-1][2] >= left:
                done.append(stack.pop()[:2])
            if not stack or stack[-1][3] >= total:
                stack.append((s, end, left, total))
                break
            s, _, left, _ = stack.pop()
    out: list[tuple[int, int]] = []
    for a, b in sorted(done + [x[:2] for x in stack], key=lambda x: (x[0], -x[1])):
        if not out or a >= out[-1][1]:  # else it was joined into the wider one
            out.append((a, b))
    return out


def to_bytes(run: str, wrong: str) -> bytes | None:
    try:
        if wrong == "sloppy":  # Windows-1252, its five holes and the C1 controls as Latin-1
            return b"".join(ch.encode("latin-1") if ord(ch) < 256 else ch.encode("cp1252") for ch in run)
        return run.encode(wrong)
    except UnicodeError:
        return None


@lru_cache(maxsize=100_000)
def readings(run: str) -> list[tuple[str, int, str]]:
    """(text, number of multi-byte sequences, mapping) of every inverse mapping that reads the whole run."""
    out = []
    for wrong in _WRONG:
        b = to_bytes(run, wrong)
        if b is None or not any(x >= 0x80 for x in b):
            continue
        for right in ("utf-8",) if wrong == "cp949" else ("utf-8", "euc_kr"):
            try:
                s = b.decode(right)
            except UnicodeError:
                continue
            if s != run and (right == "utf-8" or sum("가" <= ch <= "힣" for ch in s) * 2 >= len(s)):
                out.append((s, sum(ord(ch) >= 0x80 for ch in s), f"{right} as {wrong}"))
    return out


@lru_cache(maxsize=100_000)
def printable(s: str) -> bool:
    """Whether a text is made of assigned characters without controls; which script they are of is for the counts to judge."""
    return all(ch in "\t\n\r" or unicodedata.category(ch) not in ("Cc", "Cn", "Co", "Cs") for ch in s)


def better(p: Pairs, before: str, run: str, after: str, trusted: frozenset = frozenset()):
    """(text, mapping) of the best reading of the run between its neighbours, over several rounds of wrong reading, or None.

    A short reading that the counts neither like nor dislike is taken only under a mapping that longer runs of the text have
    shown to be at work (`trusted`)."""
    key = before, run, after, trusted
    if key not in p.read:
        if len(p.read) > 100_000:  # a memory bound; the value is the same either way
            p.read.clear()
        p.read[key] = _better(p, *key)
    return p.read[key]


def _better(p: Pairs, before: str, run: str, after: str, trusted: frozenset):
    best = old = None
    front = {run: (0, "")}
    for _ in range(MAX_ROUNDS):
        new = {}
        for t in front:
            for s, n, m in readings(t):
                new[s] = n, m
        for s, (n, m) in new.items():
            if "�" in s:
                return s, m  # the wrong reading is plain, the original is lost
            if printable(s):
                old = p.rate(before + run + after) if old is None else old
                gain = p.rate(before + s + after) - old
                # C1 controls are no text, so what reads them as text needs no likelihood beside it.
                if (gain > 0.5 or (n >= 4 or m in trusted) and gain > -0.5 or _C1.search(run)) and (best is None or gain > best[0]):
                    best = (gain, s, m if n >= 4 else "")
        front = new
        if not front:
            break
    return best and best[1:]


_RUN = re.compile("[^\x00-\x7f]+")


def repaired(p: Pairs, text: str) -> tuple[str, int, int]:
    """(text with the original where it can be had, restored places, lost places)."""
    if text.isascii():
        return text, 0, 0
    c = codes_of(text)
    odd = (c >= 0x80) & ~((c >= 0xAC00) & (c <= 0xD7A3))
    for m in _AS_HANGUL.finditer(text):
        odd[m.start() : m.end()] = True
    if not odd.any():
        return text, 0, 0
    score = np.concatenate([BITS - p.information(c), [0.0]]) if len(c) > 1 else np.zeros(1)
    wild = (c == 0xFFFD) | ((c >= 0x80) & (c <= 0x9F) & (c != 0x85))
    score[wild] = np.maximum(score[wild], 4.0)
    bad = score > 0
    if not (odd & (bad | np.concatenate([[False], bad[:-1]]))).any():
        return text, 0, 0  # no odd character has an improbable neighbour, so no segment can hold one
    inside = np.zeros(len(c) + 1, dtype=bool)
    for s, e in segments(score):
        inside[s : e + 1] = True
    places = [x for m in _RUN.finditer(text) if (inside[slice(*m.span())] & odd[slice(*m.span())]).any() for x in _parts(text, *m.span())]
    read: dict[tuple[int, int], tuple[str, str] | None] = {}
    for a, b in places:
        if not _LOST.search(text, a, b):
            read[a, b] = better(p, text[max(0, a - 2) : a], text[a:b], text[b : b + 2])
    if trusted := frozenset(r[1] for r in read.values() if r and r[1]):
        for a, b in read:
            if read[a, b] is None:
                read[a, b] = better(p, text[max(0, a - 2) : a], text[a:b], text[b : b + 2], trusted)
    out, last, good, lost = [], 0, 0, 0
    for a, b in places:
        r = read.get((a, b))
        if r is None:
            lost += (a, b) not in read or bool(_C1.search(text, a, b))
            continue
        good += "�" not in r[0]
        lost += "�" in r[0]
        out += [text[last:a], r[0]]
        last = b
    return "".join([*out, text[last:]]), good, lost


def _parts(text: str, s: int, e: int):
    """A run of non-ASCII characters, whole if it can be read otherwise, else its stretches of one kind."""
    run = text[s:e]
    if readings(run) or "�" in run:
        return [(s, e)]
    kinds = [(m.start() + s, m.end() + s) for m in re.finditer("[가-힣]+|[‘-”]+|[^가-힣‘-”]+", run)]
    out = [(s, e)] if len(kinds) == 1 else kinds
    wide = [(m.start() + s, m.end() + s) for m in re.finditer("[^가-힣]+", run)]
    hangul = [m.span() for m in _AS_HANGUL.finditer(text, s, e)]
    if any(readings(text[a:b]) for a, b in wide):
        return sorted(wide + hangul)
    return sorted(hangul + [x for x in out if not any(x[0] <= a < x[1] for a, _ in hangul)]) if hangul else out


def _repair(p: Pairs, with_text: bool):
    def run(batches):
        for pdf in batches:
            out = []
            for d, t in zip(pdf["doc_id"], pdf["text"]):
                s, good, lost = repaired(p, t)
                if good or lost:
                    out.append((d, s if with_text else None, good, lost))
            yield pd.DataFrame(out, columns=["doc_id", "text", "restored", "lost"]).astype({"doc_id": "int64", "restored": "int64", "lost": "int64"})

    return run


def repairs(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """(doc_id, text, restored, lost) of the documents with garbled places: the text with every restorable place
    restored, and how many places were restored and are lost. Null ids and texts give no rows; in texts without pairs
    and in corpora of one text nothing but lost characters is found."""
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), "text")
    p = statistics(docs)
    return docs.where(F.col("text").rlike("[^\\x00-\\x7f]")).mapInPandas(_repair(p, with_text), "doc_id long, text string, restored long, lost long")

