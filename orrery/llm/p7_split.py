"""Splitting oversized items at natural boundaries (problem 7).

All boundaries of an item are joined to their farthest legal successor, with the overlap taken back; the successor table
is then squared again and again, so every cut that a left-to-right walk would make is known after log2 steps.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.once import once

LIMIT = 1500
OVERLAP = 200

#: Boundaries from best to worst: paragraph, line, sentence, clause, word.
_KINDS = [
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n\s*"),
    re.compile(r"[.!?。！？…][\"'”’»)\]]*\s+"),
    re.compile(r"[,;:，；：]\s+|\s[―—–-]\s"),
    re.compile(r"\s+"),
]
_MARKS = re.compile("[̀-ͯᅠ-ᇿ︀-️‍\U0001f3fb-\U0001f3ff]")


def starts_of(text: str, ends: np.ndarray, limit: int, overlap: int) -> np.ndarray:
    """Where the pieces behind the ends start: `overlap` before them, and before any combining marks that begin there, as
    long as these are no more than half of what a piece brings anew."""
    start = np.maximum(ends - overlap, 0)
    if _MARKS.search(text):
        base = np.ones(len(text) + 1, dtype=bool)
        base[[m.start() for m in _MARKS.finditer(text)]] = False
        base[0] = True
        back = np.maximum.accumulate(np.where(base, np.arange(len(base)), 0))[start]
        start = np.where(start - back <= (limit - overlap) // 2, back, start)
    return start


def successors(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[np.ndarray, np.ndarray]:
    """(ends, succ): the sorted places at which pieces can end, 0 first and the length last, and for each the index of
    the place where the next piece ends. The piece after the end e starts at e - overlap (the first at 0) and takes the
    farthest boundary of the best kind that lies in the second half of its room, else the farthest boundary at all,
    else the limit itself."""
    n = len(text)
    step = limit - overlap
    kinds = [np.array([m.end() for m in p.finditer(text)], dtype=np.int64) for p in _KINDS]
    kinds = [k[~_is_mark(text, k)] for k in kinds]
    nat = np.unique(np.concatenate([*kinds, [0]]))
    nat = nat[nat < n]
    # Where no boundary lies within a piece's reach, cuts go on in steps of the room, from the last boundary on.
    gap = np.diff(np.append(nat, n))
    wide = np.flatnonzero(gap > step)
    hard = [nat[i] + np.arange(step + (limit - step if nat[i] == 0 else 0), gap[i], step) for i in wide]
    ends = np.unique(np.concatenate([nat, *hard, [0, n]]).astype(np.int64))
    ends = ends[(ends == 0) | (ends == n) | ~_is_mark(text, ends)]
    start = starts_of(text, ends, limit, overlap)
    far = np.minimum(start + limit, n)
    best = np.full(len(ends), -1, dtype=np.int64)
    for p in kinds:
        if len(p):
            at = np.searchsorted(p, far, side="right") - 1
            ok = (best < 0) & (at >= 0) & (p[np.maximum(at, 0)] > (ends + far) // 2)
            best[ok] = p[at[ok]]
    last = ends[np.searchsorted(ends, far, side="right") - 1]
    best = np.where(best < 0, last, best)
    best = np.where(start + limit >= n, n, best)
    best = np.where(best <= ends, np.minimum(start + limit, n), best)  # only behind a combining mark at the limit
    extra = np.setdiff1d(best, ends)
    if len(extra):  # such places need successors of their own
        ends, succ = _walk(text, ends, best, extra, limit, overlap)
        return ends, succ
    return ends, np.searchsorted(ends, best)


def _is_mark(text: str, at: np.ndarray) -> np.ndarray:
    if not _MARKS.search(text):
        return np.zeros(len(at), dtype=bool)
    return np.array([0 < i < len(text) and bool(_MARKS.match(text[i])) for i in at], dtype=bool)


def _walk(text, ends, best, extra, limit, overlap):
    """The table with the places that are no boundaries, each with the farthest place its piece can reach, until they meet
    the end or a place that is in the table."""
    n, known, more, nxt = len(text), set(ends.tolist()), [], []
    for e in extra.tolist():
        while e < n and e not in known:
            known.add(e)
            more.append(e)
            e = min(int(starts_of(text, np.array([e]), limit, overlap)[0]) + limit, n)
            nxt.append(e)
    allv = np.concatenate([ends, np.array(more, dtype=np.int64)])
    reach = np.concatenate([best, np.array(nxt, dtype=np.int64)])
    order = np.argsort(allv)
    return allv[order], np.searchsorted(allv[order], reach[order])


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of all pieces, by pointer doubling over the successor table."""
    n = len(text)
    if n <= limit:
        return [(0, n)] if n else []
    ends, succ = successors(text, limit, overlap)
    reached = np.zeros(len(ends), dtype=bool)
    reached[0] = True
    jump = succ
    while True:  # after k rounds: all places within 2^k - 1 pieces of the start, and jumps of 2^k pieces
        now = reached.copy()
        now[jump[reached]] = True
        if (now == reached).all() and now[-1]:
            break
        reached, jump = now, jump[jump]
    e = ends[reached]
    e = e[e > 0]
    s = np.concatenate([[0], starts_of(text, e[:-1], limit, overlap)])
    return list(zip(s.tolist(), e.tolist()))


_PIECES = "item_table string, item_key string, piece_no long, start long, end long, text string"


def _cut(limit: int, overlap: int, oversized_only: bool, with_text: bool):
    def run(batches):
        for pdf in batches:
            out = []
            for tab, key, text in zip(pdf["item_table"], pdf["item_key"], pdf["text"]):
                c = cuts(text, limit, overlap)
                if len(c) > 1 or not oversized_only:
                    out += [(tab, key, k, a, b, text[a:b] if with_text else None) for k, (a, b) in enumerate(c, 1)]
            yield pd.DataFrame(out, columns=["item_table", "item_key", "piece_no", "start", "end", "text"])

    return run


def pieces(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP, oversized_only: bool = False, with_text: bool = True, unique: bool = True) -> DataFrame:
    """Pieces of (item_table, item_key, text) items: at most `limit` code points each, `overlap` of them shared with the
    piece before; start and end count code points from 0. Null and empty texts have no pieces, texts within the limit
    one. Repeated items come out once per distinct text, unless `unique` is off, which saves a shuffle of the texts."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be smaller than limit")
    src = items.where(F.col("text").isNotNull() & F.col("item_key").isNotNull())
    if oversized_only:
        src = src.where(F.length("text") > limit)
    src = src.select("item_table", "item_key", "text")
    return (once(src, ["item_table", "item_key"], "text") if unique else src).mapInPandas(_cut(limit, overlap, oversized_only, with_text), _PIECES)


def items(bill_text: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    one = lambda t, key, text: t.select(F.lit(None).cast("string").alias("item_table"), key.alias("item_key"), text.alias("text"))
    return (
        one(bill_text, F.col("bill_id"), F.col("full_text")).withColumn("item_table", F.lit("bill_text"))
        .unionByName(one(documents, F.concat("source", F.lit(":"), "doc_id"), F.col("full_text")).withColumn("item_table", F.lit("document_text")))
        .unionByName(one(chunks, F.col("chunk_id"), F.col("text")).withColumn("item_table", F.lit("chunks")))
    )


def rebuilt(items: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(item_table, item_key, digest, fits, joined) of every item with text, for a check of the cuts: the digest of the
    text put together from its pieces, whether all are within the limit, and whether all begin at least `overlap` before
    the end of the piece before and go on behind it."""
    src = items.withColumn("item_key", F.concat("item_key", F.lit("|"), F.md5("text")))
    p = F.sort_array(F.collect_list(F.struct("piece_no", "start", "end", "text")))
    rows = pieces(src, limit, overlap).groupBy("item_table", "item_key").agg(p.alias("p"))
    fresh = F.transform("p", lambda x, i: F.when(i == 0, x["text"]).otherwise(F.substring(x["text"], F.get("p", i - 1)["end"].cast("int") - x["start"].cast("int") + 1, F.lit(limit))))
    joined = F.forall(F.sequence(F.lit(0), F.size("p") - 1), lambda i: (i == 0) | ((F.get("p", i)["start"] <= F.get("p", i - 1)["end"] - overlap) & (F.get("p", i)["end"] > F.get("p", i - 1)["end"])))
    return rows.select("item_table", F.substring_index("item_key", "|", 1).alias("item_key"), F.md5(F.array_join(fresh, "")).alias("digest"), F.forall("p", lambda x: F.length(x["text"]) <= limit).alias("fits"), joined.alias("joined"))


def found(all_items: DataFrame) -> DataFrame:
    """Items that needed more than one piece."""
    return pieces(all_items, oversized_only=True, with_text=False, unique=False).where("piece_no = 2").select("item_table", "item_key").distinct()
