"""Evaluation texts leaking into training text (problem 8).

Spaced seeds: fixed masks over the words ignore some of them, so a passage is met although words in it were replaced by
longer or shorter ones; two masks over blocks of letters meet passages whose spacing is gone. Test seeds and training
seeds are two tables joined by their hash, however many test items there are; a bitmap of the test seeds keeps most
training seeds from leaving their task. Around diagonals with hits that spread, the passage is verified on the
letters, tolerating isolated changed words.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.bits import bitmap, has
from orrery.llm.p5_copies import salted_join
from orrery.session import broadcast_checked

#: Masks over consecutive words: 1 is compared, 0 ignored.
WORD_MASKS = ("11101101", "10110111", "110110101")
#: Masks over consecutive blocks of BLOCK letters and digits.
LETTER_MASKS = ("11111", "1101011")
BLOCK = 4
MIN_LETTERS = 120
#: Changed words are isolated as long as so much of the passage's letters is unchanged.
MIN_MATCHED = 0.8
MIN_RUN = 6
#: A changed word has at most so many letters.
MAX_WORD = 40
#: Places of the first and the last hit in the item, in letters: a passage of 120 letters has seeds this far apart.
MIN_SPREAD = 40
#: Diagonals up to so far apart count as one alignment; each changed word moves the diagonal by a few letters.
BAND = 32
#: Up to so many test seeds are broadcast; beyond that both sides are shuffled.
BROADCAST_SEEDS = 200_000

_WORD = re.compile(r"[^\W_]+")
_BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower() if text.isascii() else unicodedata.normalize("NFKC", text).casefold())


def letters(words: list[str]) -> np.ndarray:
    """Code points of the letters and digits."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4")


def numbers(words: list[str]) -> np.ndarray:
    """The number of the word that each letter belongs to."""
    return np.repeat(np.arange(len(words)), [len(w) for w in words])


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, as many as the longest text so far asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int):
        if n >= len(self.up):
            size = 1 << (n + 1).bit_length()
            grow = lambda x: np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(size - 1, x, dtype=np.uint64)]))
            self.up, self.down = grow(_BASE), grow(pow(_BASE, -1, 1 << 64))
        return self


_powers = _Powers()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def _masked(h: np.ndarray, mask: str, salt: int, stride: int = 1) -> np.ndarray:
    """The hash of the mask laid at every start; neighbours under the mask lie `stride` apart in h."""
    n = max(0, len(h) - (len(mask) - 1) * stride)
    x = np.full(n, salt, dtype=np.uint64)
    for k, bit in enumerate(mask):
        if bit == "1":
            x = x * _U(_BASE) + h[k * stride : k * stride + n]
    return _mixed(x)


def seeds(words: list[str], every: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes as int64, places): a seed for every mask and start, its place being the letter it begins at. Blocks of
    letters begin at every letter if `every`, as for test items, else at every BLOCK-th."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    begins = ends - sizes
    c = letters(words).astype(np.uint64) + _U(1)
    p = _powers.reach(len(c))
    total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(c * p.up[: len(c)], dtype=np.uint64)])
    of = lambda s, e: _mixed((total[e] - total[s]) * p.down[s] + (e - s).astype(np.uint64))
    out, at = [], []
    words_h = of(begins, ends)
    for k, mask in enumerate(WORD_MASKS):
        out.append(_masked(words_h, mask, k + 1))
        at.append(begins[: len(out[-1])])
    s = np.arange(0, len(c) - BLOCK + 1, 1 if every else BLOCK, dtype=np.int64)
    blocks = of(s, s + BLOCK)
    for k, mask in enumerate(LETTER_MASKS):
        out.append(_masked(blocks, mask, 101 + k, BLOCK if every else 1))
        at.append(s[: len(out[-1])])
    return np.concatenate(out).view(np.int64), np.concatenate(at)


def _item_seeds(batches):
    for pdf in batches:
        keys, hs, places = [], [], []
        for k, text in zip(pdf["item"], pdf["text"]):
            words = words_of(text)
            if sum(map(len, words)) < MIN_LETTERS:
                continue
            h, at = seeds(words, True)
            keys.append(np.full(len(h), k, dtype=np.int64))
            hs.append(h)
            places.append(at)
        if keys:
            yield pd.DataFrame({"h": np.concatenate(hs), "item": np.concatenate(keys), "at": np.concatenate(places)})


def _doc_seeds(bits: np.ndarray):
    def run(batches):
        for pdf in batches:
            docs, hs, places = [], [], []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                h, at = seeds(words_of(text), False)
                some = np.flatnonzero(has(bits, h))
                if len(some):
                    docs.append(np.full(len(some), d, dtype=np.int64))
                    hs.append(h[some])
                    places.append(at[some])
            if docs:
                yield pd.DataFrame({"h": np.concatenate(hs), "doc_id": np.concatenate(docs), "place": np.concatenate(places)})

    return run


def passage(a, aw, b, bw, d0: int, d1: int, lo: int, hi: int) -> bool:
    """Whether a chain of equal runs around a[lo:hi], each link across at most one changed word, reaches the length.

    Runs are looked for on all diagonals from d0 to d1 and a few beyond, since a run between two changed words may be too
    short for a seed."""
    s0, e0 = max(0, lo - 300), min(len(a), hi + 324)
    diags = np.arange(d0 - 6, d1 + 7)
    place = np.arange(s0, e0) + diags[:, None]
    inside = (place >= 0) & (place < len(b))
    equal = np.zeros((len(diags), e0 - s0 + 2), dtype=np.int8)
    equal[:, 1:-1] = (b[np.clip(place, 0, len(b) - 1)] == a[s0:e0]) & inside
    turn = np.diff(equal, axis=1)
    row, begin = np.nonzero(turn == 1)
    end = np.nonzero(turn == -1)[1]
    long = end - begin >= MIN_RUN
    runs = sorted(zip((begin[long] + s0).tolist(), (end[long] + s0).tolist(), diags[row[long]].tolist()))
    best: list[tuple[int, int]] = []  # matched letters and begin of the best chain that ends with the run
    for i, (s, e, d) in enumerate(runs):
        top = (e - s, s)
        for j in range(i - 1, -1, -1):
            s2, e2, d2 = runs[j]
            x, y = max(s, e2, e2 + d2 - d), e  # the later run gives way where both claim letters
            if y - x < MIN_RUN or x - e2 > MAX_WORD:
                continue
            if not (_one_word(aw, e2, x) and _one_word(bw, e2 + d2, x + d)):
                continue
            top = max(top, (best[j][0] + y - x, best[j][1]))
        best.append(top)
        span = e - top[1]
        if span >= MIN_LETTERS and top[0] >= MIN_MATCHED * span:
            return True
    return False


def _one_word(w, s: int, e: int) -> bool:
    """Letters s to e lie in at most one word, or in two of which the runs around cover a part."""
    return e <= s or w[e - 1] - w[s] <= 1


def _verify(batches):
    last, split, codes, nums = None, None, None, None
    known: dict[int, tuple] = {}
    for pdf in batches:
        out = []
        for d, text, item, key, item_text, spans in zip(pdf["doc_id"], pdf["text"], pdf["item_id"], pdf["item"], pdf["item_text"], pdf["spans"]):
            if text is not last:
                if text != last:
                    split = words_of(text)
                    codes, nums = letters(split), numbers(split)
                last = text
            if key not in known:
                if len(known) > 2000:
                    known.clear()
                w = words_of(item_text)
                known[key] = (letters(w), numbers(w))
            if any(passage(*known[key], codes, nums, s["d0"], s["d1"], s["lo"], s["hi"]) for s in spans):
                out.append((d, item))
        yield pd.DataFrame(out, columns=["doc_id", "item_id"]).astype("int64")


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item, spans): documents and items that share seeds along one alignment, and where.

    Heavy seeds are spread over salts. Hits fall into bands of diagonals, each with the next one, so an alignment that
    drifts across a border is seen as a whole."""
    test = items.mapInPandas(_item_seeds, "h long, item long, at int").distinct().persist()
    bits = bitmap(test.select("h").distinct(), F.col("h"))
    train = docs.mapInPandas(_doc_seeds(bits), "h long, doc_id long, place int")
    # One row per seed on the test side, so a seed that many documents hold is spread over tasks, with all its places.
    places = test.groupBy("h").agg(F.collect_list(F.struct("item", "at")).alias("where"))
    if test.limit(BROADCAST_SEEDS + 1).count() <= BROADCAST_SEEDS:
        met = train.join(F.broadcast(places), "h")
    else:
        train = train.persist()
        met = salted_join(train, places.join(train.groupBy("h").agg(F.count("*").alias("members")), "h"), ["h"])
    hits = met.select("doc_id", "place", F.explode("where").alias("w")).select("doc_id", "w.item", "w.at", (F.col("place") - F.col("w.at")).alias("d"))
    band = F.floor(F.col("d") / BAND)
    spans = (
        hits.withColumn("band", F.explode(F.array(band, band - 1)))
        .groupBy("doc_id", "item", "band").agg(F.min("d").alias("d0"), F.max("d").alias("d1"), F.min("at").alias("lo"), F.max("at").alias("hi"))
        .where(F.col("hi") - F.col("lo") >= MIN_SPREAD)
    )
    return spans.groupBy("doc_id", "item").agg(F.collect_list(F.struct("d0", "d1", "lo", "hi")).alias("spans"))


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item: at least 120 letters and digits in a row,
    apart from isolated changed words; typesetting doesn't matter. Null texts and ids give no rows; an empty item table
    gives none. The documents are read twice however many items there are: for their seeds, and for the texts of the
    candidates."""
    docs = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull() & (F.length("text") >= MIN_LETTERS)).select(F.col("doc_id").cast("long"), "text")
    tests = items.where(F.col("text").isNotNull() & F.col("item_id").isNotNull()).select(F.col("item_id").cast("long").alias("item_id"), "text").distinct().withColumn("item", F.xxhash64("item_id", "text"))
    pairs = candidates(docs, tests.select("item", "text")).persist()
    rows = docs.join(broadcast_checked(pairs), "doc_id").join(broadcast_checked(tests.withColumnRenamed("text", "item_text")), "item")
    return rows.select("doc_id", "text", "item_id", "item", "item_text", "spans").mapInPandas(_verify, "doc_id long, item_id long").distinct()
