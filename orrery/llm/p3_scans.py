"""Noise in text from scanned pages (problem 3).

Page furniture and cut words are found within each document. Wrong characters are corrected by a noisy channel: every
reading of a line that the confusion table allows is scored by the confusions' probabilities times the likelihood of
its character 4-grams in the whole corpus, and the best is decoded by Viterbi over the alternatives of all words of the
line.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.counts import Table, pruned, tallied
from orrery.llm.once import once

#: n-gram counts are exact; n-grams that make up less than this share of all of their order count as unseen, so there are
#: four million others at most, whatever the corpus.
SHARE = 2.0**-20
ORDER = 4
BACKOFF = 0.4

# What is read, what was printed, log probability of the confusion. They hold where the corpus is too small to
# show a confusion by itself (see `learned`); what it shows takes their place.
HANGUL = {"익": "의", "욜": "을", "즤": "지", "콩": "공", "졍": "정", "얀": "안", "힌": "한", "샤": "사", "픔": "품", "룰": "률", "볍": "법", "쟝": "장"}
PAIRS = {"0|": "이", "O|": "이", "7|": "기", "rn": "m"}
LATIN = {"c": "e", "0": "o", "1": "l", "|": "I", "4": "A"}
DIGITS = {"O": "0", "o": "0", "l": "1", "I": "1", "|": "1", "Z": "2", "S": "5", "b": "6", "B": "8"}
SPECKS = "■¦|"
LOG_HANGUL, LOG_PAIR, LOG_LATIN, LOG_DIGIT, LOG_SPECK = -0.1, -0.5, -3.0, -1.5, -0.5

_SUSPECT = re.compile("[" + "".join(HANGUL) + SPECKS + r"]|[A-Za-z][014]|[014][A-Za-z]|[OolIZSbB][\d.,]|[\d.,][OolIZSbB]|제[OolIZSbB]|(?<![A-Za-z])[OolIZSbB]{1,3}(?![A-Za-z])|[A-Za-z]c|c[A-Za-z]|rn")
_HYPHENS = "-–‐­¬"
_NUM = r"[\dOolIZSbB|]{1,5}"
_MARK = rf"(?:[-―–—]\s?{_NUM}\s?[-―–—]|p\.\s?{_NUM}|제\s?{_NUM}\s?쪽|Page\s{_NUM}\sof\s{_NUM}|\[\s?{_NUM}\s?\]|{_NUM}\s?/\s?{_NUM})"
_ALONE = re.compile(rf"^{_MARK}$")
_BARE = re.compile(rf"^{_NUM}$")
_BEHIND = re.compile(rf"\s{{2,}}({_MARK}|{_NUM})$")
_BEFORE = re.compile(rf"^({_MARK}|{_NUM})\s{{2,}}(?=\S)")
_FOLD = str.maketrans({**HANGUL, "c": "e", "0": "o", "O": "o", "1": "l", "I": "l", **{x: "" for x in SPECKS}})

KINDS = ("running", "page_no", "split_word", "misread")


# -- the corpus' n-grams ------------------------------------------------------------------------------------------


def normal(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"\d", "0", text))


def packed(texts) -> np.ndarray:
    """The 4-gram that begins at every character of every text, and at the two spaces before it, in 16 bits a character.
    Shorter n-grams are the beginnings of these, with zeros behind."""
    whole = "   ".join(["", *map(normal, texts), ""])
    c = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    c[(c > 0xFFFF) | (c == 0)] = 0xFFFF
    return (c[:-3] << np.uint64(48) | c[1:-2] << np.uint64(32) | c[2:-1] << np.uint64(16) | c[3:]).view(np.int64) if len(c) > 3 else np.empty(0, dtype=np.int64)


def _count(batches):
    yield from tallied(packed(pdf["text"]) for pdf in batches)


#: What an n-gram of so many characters keeps of a packed 4-gram, as signed numbers.
_KEEP = [-(1 << (16 * (ORDER - k))) for k in range(1, ORDER + 1)]


class Grams:
    """Counts of all 1- to 4-grams, and the likelihood of a character behind others with backoff to shorter ones."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, total: float, confusions: dict | None = None):
        self.confusions = confusions if confusions is not None else learned(keys, counts, total)
        self.table, self.total, self.known = Table(keys, cleaned(keys, counts, self.confusions)), max(1.0, total), {}
        self.counted: dict[str, float] = {}
        own = "".join(map(re.escape, self.confusions))
        self.suspect = re.compile((f"[{own}]|" if own else "") + _SUSPECT.pattern)
        self.places = re.compile("[" + own + "".join(map(re.escape, {*HANGUL, *LATIN, *DIGITS, *SPECKS, *(x[0] for x in PAIRS)})) + "]")

    def __getstate__(self):
        return self.__dict__ | {"known": {}, "counted": {}}

    def count(self, s: str) -> float:
        got = self.counted.get(s)
        if got is None:
            key = 0
            for ch in s:
                c = ord(ch)
                key = key << 16 | (c if 0 < c <= 0xFFFF else 0xFFFF)
            if len(self.counted) > 500_000:  # a memory bound, as below
                self.counted.clear()
            got = self.counted[s] = self.table.one(key << 16 * (ORDER - len(s)))
        return got

    def log(self, context: str, ch: str) -> float:
        s = context[-(ORDER - 1) :] + ch
        got = self.known.get(s)
        if got is None:
            factor = 0.0
            got = math.log(0.5 / self.total) + ORDER * math.log(BACKOFF)
            for k in range(len(s)):
                n = self.count(s[k:])
                below = self.count(s[k:-1]) if k < len(s) - 1 else self.total
                if n >= 2 and below >= 2:  # one count is the line itself, which must not vouch for itself
                    got = factor + math.log(min(1.0, (n - 1) / (below - 1)))
                    break
                factor += math.log(BACKOFF)
            if len(self.known) > 500_000:  # a memory bound; the value is the same either way
                self.known.clear()
            self.known[s] = got
        return got

    def text(self, s: str) -> float:
        s = normal(s)
        return sum(self.log(s[max(0, i - ORDER + 1) : i], s[i]) for i in range(len(s)))


def statistics(texts: DataFrame) -> Grams:
    """n-gram counts over all texts, and the confusions they show; the driver gets the frequent n-grams only."""
    four = texts.where(F.col("text").isNotNull()).select("text").mapInPandas(_count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).persist()
    total = float(four.agg(F.sum("n")).first()[0] or 0)
    every = F.array(*[F.col("key").bitwiseAND(F.lit(k)) for k in _KEEP])
    t = pruned(four.select(F.explode(every).alias("key"), "n").groupBy("key").agg(F.sum("n").alias("n")), total, SHARE, 2)
    four.unpersist()
    return Grams(t["key"].to_numpy(dtype=np.int64), t["n"].to_numpy(dtype=np.float64), total)


#: A character is a confusion of another if it takes its place at an even rate: in so many of the surroundings where it
#: must be seen at that rate it is seen, and there are so many such surroundings.
MIN_COVER, MIN_PLACES, MAX_RATE = 0.5, 8, 0.2
#: A surrounding fits a rate up to so many times its expected count, and three more for chance.
SLACK = 4


def learned(keys: np.ndarray, counts: np.ndarray, total: float) -> dict[str, list[tuple[str, float]]]:
    """Read character: [(printed character, probability of the confusion)], estimated from the corpus.

    In each surrounding of a hole (two or three characters of a 4-gram) the most frequent letter is taken as printed. A
    letter that scans make of another stands in nearly all of the other's frequent surroundings, at one rate; a letter
    that language puts in its place stands in a few, at any rate. Rates are estimated from the expected counts, once for
    all surroundings and then again over those in which the letter isn't explained otherwise."""
    k, n = keys.view(np.uint64), counts
    at = [(k >> np.uint64(48 - 16 * i)) & np.uint64(0xFFFF) for i in range(ORDER)]
    full = at[3] > 0
    least = max(2.0, total * SHARE)
    letter = np.zeros(1 << 16, dtype=bool)
    letter[[c for c in range(1, 1 << 16) if chr(c).isalpha() and not 0xD800 <= c < 0xE000]] = True
    seen, support = {}, {}
    for hole in (1, 2):
        x, ctx, m = at[hole][full], (k[full] & ~(np.uint64(0xFFFF) << np.uint64(48 - 16 * hole))), n[full]
        ok = letter[x]
        x, ctx, m = x[ok], ctx[ok], m[ok]
        order = np.lexsort((-m, ctx))
        x, ctx, m = x[order], ctx[order], m[order]
        first = np.flatnonzero(np.concatenate([[True], ctx[1:] != ctx[:-1]])) if len(ctx) else np.empty(0, dtype=np.int64)
        size = np.diff(np.append(first, len(ctx)))
        top, top_n = np.repeat(x[first], size), np.repeat(m[first], size)
        for y, c in zip(x[first].tolist(), m[first].tolist()):
            support.setdefault(y, []).append(c)
        minor = (x != top) & (m < MAX_RATE * top_n)
        for a, y, c, t in zip(x[minor].tolist(), top[minor].tolist(), m[minor].tolist(), top_n[minor].tolist()):
            seen.setdefault((a, y), []).append((c, t))
    out: dict[str, list[tuple[str, float]]] = {}
    for (a, y), rows in seen.items():
        if len(rows) < MIN_PLACES:
            continue
        tops = np.array(support[y])
        c, t = np.array(rows).T
        rate = c.sum() / tops.sum()
        for _ in range(8):  # rate, then the surroundings that fit it, until both settle
            fits = c < SLACK * rate * t + 3
            new = c[fits].sum() / tops.sum()
            if abs(new - rate) < 1e-9:
                break
            rate = new
        due = tops * rate >= 2 * least
        if due.sum() >= MIN_PLACES and (t[fits] * rate >= 2 * least).sum() >= MIN_COVER * due.sum():
            out.setdefault(chr(a), []).append((chr(y), float(rate)))
    return out


def cleaned(keys: np.ndarray, counts: np.ndarray, confusions: dict[str, list[tuple[str, float]]]) -> np.ndarray:
    """Counts without what the learned confusions explain: misread n-grams must not vouch for themselves.

    Texts differ in their rates, so where another letter is by far more frequent, of what is left only the share counts
    that is left of the misread letter in the whole corpus."""
    n, k, table = np.array(counts, dtype=np.float64), keys.view(np.uint64), Table(keys, counts)
    for a, into in confusions.items():
        share = None
        for i in range(ORDER):  # the first place holds the letter alone, too
            shift = np.uint64(48 - 16 * i)
            rows = np.flatnonzero((k >> shift) & np.uint64(0xFFFF) == ord(a))
            due, most = np.zeros(len(rows)), np.zeros(len(rows))
            for y, rate in into:
                other = table.get(((k[rows] & ~(np.uint64(0xFFFF) << shift)) | (np.uint64(ord(y)) << shift)).view(np.int64))
                due, most = due + SLACK * rate * other, np.maximum(most, other)
            before, n[rows] = n[rows], np.maximum(n[rows] - due, 0)
            if share is None:
                alone = np.flatnonzero(k[rows] == np.uint64(ord(a)) << shift)
                share = float((n[rows][alone] / before[alone]).sum()) if len(alone) else 0.0
            n[rows[counts[rows] < MAX_RATE * most]] *= share
    return n


# -- wrong characters ---------------------------------------------------------------------------------------------


def options(g: Grams, s: str, i: int):
    """(characters taken, printed characters, log probability) of the readings of s at i besides the plain one."""
    ch, two = s[i], s[i : i + 2]
    for y, rate in g.confusions.get(ch, ()):
        yield 1, y, math.log(rate)
    if ch in HANGUL and ch not in g.confusions:
        yield 1, HANGUL[ch], LOG_HANGUL
    if two in PAIRS:
        yield 2, PAIRS[two], LOG_PAIR if "|" in two else LOG_LATIN
    before, behind = s[i - 1] if i else " ", s[i + 1] if i + 1 < len(s) else " "
    if ch in LATIN and (before.isascii() and before.isalpha() or behind.isascii() and behind.isalpha()):
        yield 1, LATIN[ch], LOG_LATIN if ch == "c" else LOG_DIGIT
    if ch in DIGITS and not (before.isascii() and before.isalpha() and before not in DIGITS or behind.isascii() and behind.isalpha() and behind not in DIGITS):
        yield 1, DIGITS[ch], LOG_DIGIT
    if ch in SPECKS and not (before.isspace() and behind.isspace()):
        yield 1, "", LOG_SPECK


@lru_cache(maxsize=1 << 16)
def _plain(s: str) -> str:
    return "".join("0" if ch.isdigit() else " " if ch.isspace() else ch for ch in s)


def decode(g: Grams, s: str) -> str:
    """The likeliest printed line behind the line read. Where nothing can be read otherwise for more than the reach of the
    n-grams, all paths meet in one state, so only the stretches between such places are searched."""
    if not g.suspect.search(s):
        return s
    choices = {i: alt for i in (m.start() for m in g.places.finditer(s)) if (alt := list(options(g, s, i)))}
    out, last = [], 0
    at = sorted(choices)
    k = 0
    while k < len(at):
        begin = at[k]
        end = begin
        while k < len(at) and at[k] <= end + ORDER:
            end = max(end, at[k] + max(take for take, _, _ in choices[at[k]]))
            k += 1
        end = min(len(s), end + ORDER - 1)
        out += [s[last:begin], _best(g, s, begin, end, choices)]
        last = end
    return "".join([*out, s[last:]])


def _best(g: Grams, s: str, begin: int, end: int, choices: dict) -> str:
    """Viterbi over s[begin:end]; states are the last three printed characters."""
    states: list[dict[str, tuple[float, str]]] = [{} for _ in range(end - begin + 1)]
    states[0][_plain(s[max(0, begin - ORDER + 1) : begin]) or " "] = (0.0, "")
    for i in range(begin, end):
        alternatives = [x for x in choices.get(i, ()) if i + x[0] <= end]
        for tail, (score, out) in states[i - begin].items():
            for take, printed, log in ((1, s[i], 0.0), *alternatives):
                t, sc = tail, score + log
                for c in _plain(printed):
                    sc += g.log(t, c)
                    t = (t + c)[-(ORDER - 1) :]
                place = states[i - begin + take]
                old = place.get(t)
                if old is None or sc > old[0]:
                    place[t] = (sc, out + printed)
    return max(states[-1].values(), key=lambda x: x[0])[1]


# -- page furniture and cut words ---------------------------------------------------------------------------------


def fold(line: str) -> str:
    """A line's letters with everything folded that scans confuse."""
    return re.sub(r"[\W_\d]+", "", line.replace("0|", "이").replace("7|", "기").replace("rn", "m").translate(_FOLD).lower())


def alike(a: str, b: str) -> bool:
    if a == b:
        return True
    if min(len(a), len(b)) < 0.75 * max(len(a), len(b)):
        return False
    x, y = Counter(zip(a, a[1:])), Counter(zip(b, b[1:]))
    return 2 * sum((x & y).values()) >= 0.8 * (sum(x.values()) + sum(y.values()))


def like_title(line: str, title: str) -> bool:
    """Whether a folded line is the folded title, with a short addition at most."""
    return len(title) >= 4 and len(line) <= len(title) + 12 and alike(line[: len(title)], title)


def furniture(lines: list[str]) -> tuple[set[int], set[int]]:
    """(running, page_no): indices of the lines that are headers or footers, and of those that hold a page number.

    Headers repeat the title, with an addition at times, or stand beside page marks again and again. Where the text begins
    with the title twice, the first is the header of the first page."""
    filled = [i for i, x in enumerate(lines) if x.strip("\x0c \t\r　")]
    if not filled:
        return set(), set()
    marks: dict[int, str] = {}  # line with a mark: the rest of the line
    for i in filled:
        s = lines[i].strip("\x0c \t\r　")
        if _ALONE.match(s) or _BARE.match(s):
            marks[i] = ""
        elif m := _BEHIND.search(s):
            marks[i] = s[: m.start()]
        elif m := _BEFORE.match(s):
            marks[i] = s[m.end() :]
    folded = {i: fold(marks.get(i) or lines[i]) for i in filled if marks.get(i, "x")}
    text = [i for i in filled if i in folded]
    if not text:
        return set(), set(marks)
    head = text[0]
    if len(text) > 1 and (like_title(folded[text[0]], folded[text[1]]) or text[0] in marks and like_title(folded[text[1]], folded[text[0]])):
        head = text[1]
    title = folded[head]
    running = {i for i in text if i != head and like_title(folded[i], title)}
    page = {i for i, rest in marks.items() if not rest or i in running}
    pos = {i: k for k, i in enumerate(filled)}
    near = [filled[pos[i] + d] for i in page for d in (-1, 1) if 0 <= pos[i] + d < len(filled)]
    near += [i for i, rest in marks.items() if rest and i not in running]
    rest = Counter(folded[i] for i in set(near) if i in folded and i not in running and i != head)
    for i in set(near):
        if i in folded and i != head and len(folded[i]) >= 6 and rest[folded[i]] >= 2:
            running.add(i)
            if marks.get(i):
                page.add(i)
    return running, page


def cut_words(g: Grams, lines: list[str], body: list[int]) -> dict[int, int]:
    """Line whose last word is cut: body line on which it goes on."""
    out = {}
    for k, i in enumerate(body[:-1]):
        s, j = lines[i].rstrip(), body[k + 1]
        t = lines[j].lstrip("\x0c \t　")
        if len(s) < 2 or s[-1] not in _HYPHENS or not (s[-2].isalnum() or s[-2] in SPECKS) or not t or not (t[0].isalnum() or t[0] in SPECKS):
            continue
        if s[-1] in "-‐–" and s[-2].isascii() and t[0].isascii():  # a compound may be broken at its own hyphen
            left, right = re.search(r"\S+$", s[:-1])[0][-12:], re.match(r"\S+", t)[0][:12]
            if g.text(" " + left + "-" + right) > g.text(" " + left + right) + 1.0:
                continue
        out[i] = j
    return out


def analyse(g: Grams, text: str) -> tuple[list[tuple[int, str]], str]:
    """((line number from 1, kind) of every disturbed line, the text in continuous paragraphs)."""
    lines = text.split("\n")
    if not text.strip():
        return [], ""
    running, page = furniture(lines)
    found = [(i + 1, "running") for i in running] + [(i + 1, "page_no") for i in page]
    body = [i for i in range(len(lines)) if i not in running and i not in page and lines[i].strip()]
    cut = cut_words(g, lines, body)
    found += [(i + 1, "split_word") for i in cut]
    clean = {}
    joined = set(cut.values())
    for i in body:
        if i in joined:
            continue
        # Words cut at line ends are decoded whole, with a note of where each line ends.
        chain, j = [i], i
        while j in cut:
            j = cut[j]
            chain.append(j)
        parts = [lines[x].strip("\x0c \t\r　").rstrip(_HYPHENS if x in cut else "") for x in chain]
        whole = unicodedata.normalize("NFC", "".join(parts))
        fixed = decode(g, whole)
        clean[i] = fixed
        if fixed != whole:
            for x, part, (a, b) in zip(chain, parts, _bounds(parts)):
                if _touched(whole, fixed, a, b):
                    found.append((x + 1, "misread"))
    out, para = [], []
    skipped = False
    for i, raw in enumerate(lines):
        if i in clean:
            para.append(clean[i])
            skipped = False
        elif i in running or i in page:
            skipped = True
        elif not raw.strip() and not skipped and para and not _beside(lines, i, running | page):
            out.append(" ".join(para))
            para = []
    out.append(" ".join(para))
    return sorted(set(found)), "\n\n".join(p for p in out if p)


def _beside(lines, i, odd) -> bool:
    """Whether the next filled line after the blank line i is page furniture."""
    j = i + 1
    while j < len(lines) and not lines[j].strip():
        j += 1
    return j in odd


def _bounds(parts):
    at = 0
    for p in parts:
        yield at, at + len(p)
        at += len(p)


def _touched(whole: str, fixed: str, a: int, b: int) -> bool:
    """Whether a change from whole to fixed falls into whole[a:b]."""
    if a == 0 and b == len(whole):
        return True
    return any(op != "equal" and x < b and max(y, x + 1) > a for op, x, y, _, _ in SequenceMatcher(None, whole, fixed, autojunk=False).get_opcodes())


def _found(g: Grams, with_text: bool):
    def run(batches):
        for pdf in batches:
            rows = []
            for tab, key, text in zip(pdf["item_table"], pdf["item_key"], pdf["text"]):
                found, clean = analyse(g, text)
                if with_text:
                    rows.append((tab, key, None, None, clean, len(found)))
                else:
                    rows += [(tab, key, n, k, None, None) for n, k in found]
            yield pd.DataFrame(rows, columns=["item_table", "item_key", "line_no", "kind", "text", "disturbed"]).astype({"line_no": "Int64", "disturbed": "Int64"})

    return run


_ROWS = "item_table string, item_key string, line_no long, kind string, text string, disturbed long"


def items(bill_text: DataFrame, documents: DataFrame) -> DataFrame:
    """The texts in scope, one row per item and distinct text; null keys and texts are left out."""
    bills = bill_text.select(F.lit("bill_text").alias("item_table"), F.col("bill_id").alias("item_key"), F.col("full_text").alias("text"))
    docs = documents.where(F.col("source").isin("research", "report")).select(F.lit("document_text").alias("item_table"), F.concat("source", F.lit(":"), "doc_id").alias("item_key"), F.col("full_text").alias("text"))
    return bills.unionByName(docs).where(F.col("item_key").isNotNull() & F.col("text").isNotNull())


def disturbed(texts: DataFrame) -> DataFrame:
    """(item_table, item_key, line_no, kind), kinds as in KINDS. Empty texts have no rows; repeated rows count once."""
    g = statistics(texts)
    return texts.mapInPandas(_found(g, False), _ROWS).select("item_table", "item_key", "line_no", "kind").distinct()


def paragraphs(texts: DataFrame) -> DataFrame:
    """(item_table, item_key, text, disturbed): continuous paragraphs without page furniture, cut words joined, wrong
    characters corrected, and the number of findings."""
    g = statistics(texts)
    return once(texts, ["item_table", "item_key"], "text").mapInPandas(_found(g, True), _ROWS).select("item_table", "item_key", "text", "disturbed")
