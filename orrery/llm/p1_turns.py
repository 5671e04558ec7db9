"""Speech transcripts into clean speaker turns (problem 1).

Each transcript is parsed line by line into stretches of speech. Labels that give a full name build a roster of
persons and roles, per transcript and across transcripts; labels that give only a role, only a family name or a
misspelled name are blocked phonetically and assigned to the roster at least cost, each label to another person.
Chunks take the persons of the transcript that they were cut from. Labels that their own transcript leaves open go to
the cross-transcript roster, and so do full names that stand in one transcript alone: they may be a spelling of
somebody whom the other transcripts of the committee know in that role. Offices that no list has are learned from the
places where labels have them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from orrery.llm.assign import least_cost

# Office names that stand in labels, fillers, family names.
ROLES = "소위원장 부위원장 위원장 전문위원 위원 부의장 의장 의원 장관 차관 국장 진술인 참고인 증인 간사".split()
FILLERS = "어 어어 에 음 으음 아 그 저 저기 뭐 뭐랄까 허허 그러니까".split()
FAMILY = "김이박최정강조윤장임한오서신권황안송류유전홍고문양손배백허남심노하곽성차주우구나민진지엄채원천방공현함변염여추도소석선설마길연위표명기반왕금옥육인맹제모탁국어은편용예경봉사부가복태목형피두감음빈동온호범좌팽승간상시갈단견당화창"

#: Family names of two syllables; with them a name has three syllables or four.
DOUBLE = "남궁 황보 제갈 사공 선우 서문 독고 동방".split()
#: A word is an office if so many labels have it behind a name, of at least two different names.
MIN_LABELS = 3

_TIME = r"(?:\d{1,2}:\d{2}:\d{2}(?:[.,]\d+)?|\d{1,2}:\d{2}(?!\d)|\d{1,2}\s*시\s*\d{1,2}\s*분)"
_MARK = re.compile(rf"[\[(<【]\s*{_TIME}(?:\s*(?:개의|산회|정회|속개))?\s*[\])>】]|(?<![\d가-힣]){_TIME}(?![\d가-힣])")
_LEAD = re.compile(rf"^\s*(?:[\[(<【]\s*{_TIME}\s*[\])>】]|{_TIME}(?![\d가-힣]))\s*")
_NOTE = re.compile(r"\([^()\n]{1,40}\)|\[[^\[\]\n]{1,40}\]|【[^【】\n]{1,40}】|<[^<>\n]{1,40}>|\*[^*\n]{1,20}\*")
_NAME = rf"(?:(?:{'|'.join(DOUBLE)})[가-힣]{{1,2}}|[가-힣](?:\s?[가-힣]){{2}})"
_BULLET = r"[○◯●◎◇◆■□▶▷·•]"


@lru_cache(maxsize=8)
def label_forms(roles: tuple[str, ...]) -> list[re.Pattern]:
    """Label forms, tried in this order; the groups are named n (name or family name) and r (role)."""
    role = "(?:" + "|".join(sorted(roles, key=len, reverse=True)) + ")"
    return [
        re.compile(p)
        for p in (
            rf"^<\s*(?P<n>{_NAME})\s*(?P<r>{role})?\s*>",
            rf"^{_BULLET}?\s*(?P<r>{role})\s*[(（]\s*(?P<n>{_NAME})\s*[)）]\s*[:：]?",
            rf"^{_BULLET}?\s*(?P<n>)(?P<r>{role})\s*[:：]",
            rf"^{_BULLET}?\s*(?P<n>[가-힣])\s?(?P<r>{role})\s*[:：]",
            rf"^{_BULLET}?\s*(?P<n>{_NAME})\s*(?P<r>{role})?\s*[:：]",
            rf"^{_BULLET}?\s*(?P<n>[가-힣]{{2}})\s(?P<r>{role})\s*[:：]",
            rf"^\[\s*(?P<n>{_NAME})\s*(?P<r>{role})?\s*\]\s*[:：]?",
            rf"^{_BULLET}\s*(?P<n>)(?P<r>{role})\s*[―—–]\s",
            rf"^{_BULLET}\s*(?P<n>[가-힣])\s?(?P<r>{role})\s*[―—–]\s",
            rf"^{_BULLET}\s*(?P<n>{_NAME})\s*(?P<r>{role})?\s*[―—–-]\s",
            rf"^{_BULLET}\s*(?P<r>{role})\s(?P<n>[가-힣]{{3}})(?:\s\s|\s*$)",
            rf"^{_BULLET}\s*(?P<n>)(?P<r>{role})(?=\s|$)",
            rf"^{_BULLET}\s*(?P<n>[가-힣])\s?(?P<r>{role})(?=\s|$)",
            rf"^{_BULLET}\s*(?P<n>{_NAME})\s*(?P<r>{role})(?=\s|$)",
        )
    ]


#: Words for a committee that name none.
_NO_BODY = frozenset(x + "위원회" for x in "소 본 각 이 그 동 당 귀 양 해당 전체 상임 특별 우리 저희".split())
_FILLER_SET = frozenset(FILLERS)
_FAMILY_SET = frozenset(FAMILY)
_VOWEL = {1: 5, 3: 7, 10: 11, 15: 11}  # ㅐ as ㅔ, ㅒ as ㅖ, ㅙ and ㅞ as ㅚ
_ONSET = {1: 0, 4: 3, 8: 7, 10: 9, 13: 12}  # tense consonants as lax ones


def phonetic(name: str) -> str:
    """A block key under which spellings that sound alike fall together."""
    out = []
    for c in name:
        k = ord(c) - 0xAC00
        if 0 <= k < 11172:
            a, b, e = k // 588, k % 588 // 28, k % 28
            out.append(chr(0xAC00 + _ONSET.get(a, a) * 588 + _VOWEL.get(b, b) * 28 + {2: 1, 20: 19}.get(e, e)))
        else:
            out.append(c)
    return "".join(out)


def clean(text: str) -> str:
    """Speech without notes, time marks and fillers; empty if nothing else was in it."""
    s = _NOTE.sub(" ", _MARK.sub(" ", text))
    words = [w for w in s.split() if w.strip(",.…·~-―!?") not in _FILLER_SET and re.search(r"\w", w)]
    return " ".join(words)


def is_full(name: str) -> bool:
    """Whether a label's name is a person's whole name, not the family name alone."""
    return len(name) >= 2 and name not in DOUBLE


def label_of(line: str, roles: tuple[str, ...] = tuple(ROLES), forms: list[re.Pattern] | None = None):
    """(name, role, rest) if the line begins with a speaker label, else None. Time marks before it are skipped."""
    s = line
    while (m := _LEAD.match(s)) is not None and m.end():
        s = s[m.end() :]
    s = s.strip()
    for p in forms or label_forms(roles):
        if m := p.match(s):
            name = re.sub(r"\s", "", m["n"] or "")
            if name and name[0] not in _FAMILY_SET or len(name) > 1 and name in roles:
                continue
            return name, m["r"] or "", s[m.end() :]
    return None


def stretches(text: str, roles: tuple[str, ...] = tuple(ROLES)) -> list[tuple[str, str, str]]:
    """(name, role, clean speech) of every labelled stretch, those without speech too: their labels still name persons."""
    out: list[tuple[str, str, list[str]]] = []
    forms = label_forms(roles)
    for line in unicodedata.normalize("NFC", text).split("\n"):
        if hit := label_of(line, roles, forms):
            out.append((hit[0], hit[1], [hit[2]]))
        elif out:
            out[-1][2].append(line)
    return [(n, r, clean("\n".join(lines))) for n, r, lines in out]


def roster(labels) -> dict[str, Counter]:
    """Full name: counts of its roles. Spellings that sound alike are one person, under the most frequent spelling."""
    seen: dict[str, Counter] = defaultdict(Counter)
    for n, r in labels:
        if is_full(n):
            seen[n][r] += 1
    groups: dict[str, list[str]] = defaultdict(list)
    for n in seen:
        groups[phonetic(n)].append(n)
    out = {}
    for names in groups.values():
        best = max(names, key=lambda n: (sum(seen[n].values()), n))
        out[best] = sum((seen[n] for n in names), Counter())
    return out


def body_of(text: str) -> str:
    """The first committee that the text names, or ''."""
    for m in re.finditer("위원회", text):
        s = m.start()
        while s and "가" <= text[s - 1] <= "힣":
            s -= 1
        if s < m.start() and text[s : m.end()] not in _NO_BODY:
            return text[s : m.end()]
    return ""


def assign(labels, people: dict[str, Counter], across: bool = False) -> dict[tuple[str, str], str]:
    """Person of each (name, role) label, by optimal assignment inside phonetic blocks.

    Full names go to the person whose name sounds alike. Labels with a family name or none at all compete for the
    persons of that family and role: different labels of one kind go to different persons where there are enough.
    Labels that nobody fits are left out. Across transcripts a person must be known in the label's role, and of those
    who are the one seen most often is the cheapest.
    """
    out: dict[tuple[str, str], str] = {}
    by_sound = {phonetic(n): n for n in people}
    short = []
    for lab in dict.fromkeys(labels):
        n, r = lab
        if is_full(n):
            if p := by_sound.get(phonetic(n)):
                out[lab] = p
        else:
            short.append(lab)
    names = sorted(people)
    for kind in ([x for x in short if x[0]], [x for x in short if not x[0]]):
        cost = np.full((len(kind), len(names)), 1e6)
        for i, (n, r) in enumerate(kind):
            for j, p in enumerate(names):
                if n and phonetic(p[0]) != phonetic(n):
                    continue
                roles = {x for x in people[p] if x}
                if r in roles:
                    cost[i, j] = 1e-3 / (1 + people[p][r]) if across else 0
                elif across:
                    continue
                elif n:
                    cost[i, j] = 2 if not roles else 10
                elif not roles:
                    cost[i, j] = 20
        for i, j in least_cost(cost) if cost.size else []:
            if cost[i, j] < 1e6:
                out[kind[i]] = names[j]
    return out


_PARSED = "item_table string, doc_id string, source string, meeting string, body string, pos int, name string, role string, who string, speech string"


def _parse(roles: tuple[str, ...]):
    def run(batches):
        for pdf in batches:
            rows = []
            for tab, doc, src, text, meeting, committee in zip(pdf["item_table"], pdf["doc_id"], pdf["source"], pdf["text"], pdf["meeting"], pdf["committee"]):
                text = unicodedata.normalize("NFC", text)
                parts = stretches(text, roles)
                labels = [(n, r) for n, r, _ in parts]
                found = assign(labels, roster(labels))
                body = body_of(unicodedata.normalize("NFC", committee)) if isinstance(committee, str) else ""
                body = body or body_of(text)
                for k, (n, r, speech) in enumerate(parts):
                    rows.append((tab, doc, src, meeting, body, k, n, r, found.get((n, r)), speech))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in _PARSED.split(", ")])

    return run


def offices(transcripts: DataFrame) -> tuple[str, ...]:
    """The fixed offices and those that labels have: words between a full name and a colon, in at least MIN_LABELS labels
    that hold one in 100,000 of all labelled lines, so there are 100,000 at most."""
    line = F.explode(F.filter(F.split("text", "\n"), lambda x: x.contains(":") | x.contains("：")))
    label = rf"^\s*{_BULLET}?\s*([{FAMILY}][가-힣]{{2,3}})\s+([가-힣]{{2,8}})\s*[:：]"
    rows = transcripts.where(F.col("text").isNotNull()).select(line.alias("line")).where(F.col("line").rlike(label))
    rows = rows.select(F.regexp_extract("line", label, 1).alias("name"), F.regexp_extract("line", label, 2).alias("office"))
    n = rows.groupBy("office", "name").agg(F.count("*").alias("n")).groupBy("office").agg(F.sum("n").alias("n"), F.count("*").alias("names")).persist()
    every = n.agg(F.sum("n")).first()[0] or 0
    new = n.where((F.col("n") >= max(MIN_LABELS, every * 1e-5)) & (F.col("names") >= 2) & ~F.col("office").isin(ROLES)).select("office").toPandas()["office"]
    n.unpersist()
    return (*ROLES, *sorted(new))


def jamo(name: str) -> list[int]:
    return [x for c in name for k in [ord(c) - 0xAC00] for x in ((k // 588, k % 588 // 28, k % 28) if 0 <= k < 11172 else (ord(c), 0, 0))]


def _respell(pdf: pd.DataFrame) -> pd.DataFrame:
    """One transcript's full names that stand nowhere else, assigned to the persons whose names differ in one sound."""
    names, cands = sorted(set(pdf["who"])), sorted(set(pdf["cand"]))
    cost = np.full((len(names), len(cands)), 1e6)
    for w, c, seen in zip(pdf["who"], pdf["cand"], pdf["seen"]):
        if sum(x != y for x, y in zip(jamo(w), jamo(c))) == 1:
            cost[names.index(w), cands.index(c)] = 1 / (1 + seen)
    first = pdf.iloc[0]
    return pd.DataFrame([(first["item_table"], first["doc_id"], first["source"], names[i], cands[j]) for i, j in least_cost(cost) if cost[i, j] < 1e6], columns=["item_table", "doc_id", "source", "who", "right"])


#: A name is a spelling of another only if so many transcripts of the committee have the other in the same role.
MIN_SEEN = 3


def respelled(parsed: DataFrame, known: DataFrame) -> DataFrame | None:
    """(item_table, doc_id, source, who, right), or None where no name stands in one transcript alone: full names that one transcript alone has, and the person of the same body
    and role that they spell. Blocks are the name with one syllable left out, by its sound; who has the right person in
    the same transcript is somebody else."""
    item = ["item_table", "doc_id", "source"]
    full = F.length("who") >= 3
    names = parsed.where(full & (F.col("body") != "")).select(*item, F.coalesce("meeting", "doc_id").alias("of"), "body", "role", "who").distinct()
    alone = names.groupBy("who").agg(F.count_distinct("of", "source").alias("k")).where("k = 1").select("who")
    block = lambda c: F.explode(F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.lit("_"), F.substring(c, i + 1, F.length(c)))))
    rare = names.join(alone, "who").persist()
    if rare.limit(1).count() == 0:
        return None
    ask = rare.withColumn("block", block(F.col("who")))
    answer = known.where((F.col("seen") >= MIN_SEEN) & (F.length("cand") >= 3)).withColumn("block", block(F.col("cand")))
    met = ask.join(answer, ["body", "role", "block"]).where("who <> cand").select(*item, "who", "cand", "seen")
    met = met.join(names.select(*item, F.col("who").alias("cand")).distinct(), [*item, "cand"], "left_anti")
    return met.groupBy(*item).applyInPandas(_respell, "item_table string, doc_id string, source string, who string, right string")


def _meeting(pdf: pd.DataFrame) -> pd.DataFrame:
    """The persons of one meeting's labels: those of its transcript, as the transcript itself has them, and those that only
    its chunks have."""
    pdf = pdf.sort_values(["cut", "pos", "name", "role"])
    seen = [((n, r), k, c) for n, r, k, c in zip(pdf["name"], pdf["role"], pdf["n"], pdf["cut"])]
    own = [x for x, k, cut in seen if not cut for _ in range(k)]
    every = [x for x, k, _ in seen for _ in range(k)]
    taken = assign(own, roster(own))
    known = set(own)
    taken |= assign([x for x in every if x not in known], roster(every))
    first = pdf.iloc[0]
    return pd.DataFrame([(first["meeting"], first["source"], n, r, p) for (n, r), p in taken.items()], columns=["meeting", "source", "name", "role", "own"])


def _of_meeting(parsed: DataFrame) -> DataFrame:
    """Chunks with the persons of the meeting their `meeting` names; other items as they are."""
    cut = F.col("meeting") != F.col("doc_id")
    labels = parsed.where("meeting is not null").groupBy("meeting", "source", cut.alias("cut"), "name", "role").agg(F.count("*").cast("int").alias("n"), F.min("pos").alias("pos"))
    persons = labels.groupBy("meeting", "source").applyInPandas(_meeting, "meeting string, source string, name string, role string, own string")
    return parsed.join(persons, ["meeting", "source", "name", "role"], "left").withColumn("who", F.when(cut, F.col("own")).otherwise(F.col("who"))).drop("own")


def _settle(pdf: pd.DataFrame) -> pd.DataFrame:
    """One transcript's open labels against its candidates from other transcripts."""
    labels = list(dict.fromkeys(zip(pdf["name"], pdf["role"])))
    people: dict[str, Counter] = defaultdict(Counter)
    for n, r, k in dict.fromkeys(zip(pdf["cand"], pdf["role"], pdf["seen"])):
        people[n][r] += int(k)
    taken = assign(sorted(labels), people, across=True)
    first = pdf.iloc[0]
    return pd.DataFrame(
        [(first["item_table"], first["doc_id"], first["source"], n, r, taken[n, r]) for n, r in labels if (n, r) in taken],
        columns=["item_table", "doc_id", "source", "name", "role", "other"],
    )


def turns(transcripts: DataFrame) -> DataFrame:
    """Clean turns of (item_table, doc_id, source, text) transcripts: (item_table, doc_id, source, turn_no, speaker, speech).

    Transcripts must be unique by their first three columns. Null texts and texts without labels give no turns; a
    speaker whom neither the transcript nor the cross-transcript roster knows is named by the label itself. Texts of
    any length are read whole; each is one row of the input, so its stretches fit where the text fits.

    The columns `meeting` (for a piece of a transcript the doc_id of the whole, whose persons it takes) and `committee`
    may be left out; without a committee the first one that the text names counts.
    """
    pieces = "meeting" in transcripts.columns
    extra = [F.col(c) if c in transcripts.columns else F.lit(None).cast("string").alias(c) for c in ("meeting", "committee")]
    parsed = transcripts.where(F.col("text").isNotNull()).select("item_table", "doc_id", "source", "text", *extra).mapInPandas(_parse(offices(transcripts)), _PARSED)
    parsed = (_of_meeting(parsed.persist()) if pieces else parsed).persist()
    item = ["item_table", "doc_id", "source"]
    open_ = parsed.where(F.col("who").isNull() & (F.col("body") != "")).select(*item, "body", "name", "role").distinct()
    # The roster has a row per person, role and body. With k open labels in a transcript, k - 1 at most of a label's
    # candidates can be taken by the others, so no assignment of least cost goes beyond its k best.
    known = parsed.where((F.length("who") >= 2) & (F.col("body") != "")).groupBy("body", "role", F.col("who").alias("cand")).agg(F.countDistinct(F.coalesce("meeting", "doc_id"), "source").alias("seen"))
    family, order = F.substring("cand", 1, 1), [F.desc("seen"), F.asc("cand")]
    ranked = known.withColumn("family", family).withColumn("at", F.row_number().over(Window.partitionBy("body", "role").orderBy(*order))).withColumn("at_family", F.row_number().over(Window.partitionBy("body", "role", "family").orderBy(*order)))
    competing = open_.withColumn("k", F.count("*").over(Window.partitionBy(*item)))
    options = competing.join(ranked, ["body", "role"]).where(F.when(F.col("name") == "", F.col("at") <= F.col("k")).otherwise((F.col("name") == F.col("family")) & (F.col("at_family") <= F.col("k"))))
    settled = options.select(*item, "name", "role", "cand", "seen").groupBy(*item).applyInPandas(_settle, "item_table string, doc_id string, source string, name string, role string, other string")
    keys = ["item_table", "doc_id", "source", "name", "role"]
    named = parsed.join(settled, keys, "left")
    spelt = respelled(parsed, known)
    named = named.withColumn("right", F.lit(None).cast("string")) if spelt is None else named.join(spelt, [*item, "who"], "left")
    named = named.where(F.col("speech") != "")
    speaker = F.coalesce("right", "who", "other", F.when(F.col("name") != "", F.col("name")), F.col("role"))
    return (
        named.select("item_table", "doc_id", "source", "pos", speaker.alias("speaker"), "speech")
        .groupBy("item_table", "doc_id", "source")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "speaker", "speech"))).alias("s"))
        .select("item_table", "doc_id", "source", F.explode(_merged(F.col("s"))).alias("t"))
        .select("item_table", "doc_id", "source", F.col("t.no").cast("long").alias("turn_no"), F.col("t.speaker").alias("speaker"), F.col("t.speech").alias("speech"))
    )


def _merged(s):
    """Runs of one speaker as one turn each, numbered from 1."""
    starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.element_at(s, i.cast("int") + 1)["speaker"] != F.element_at(s, F.greatest(i.cast("int"), F.lit(1)))["speaker"]))

    def turn(a, k):
        end = F.coalesce(F.get(starts, k + 1), F.size(s))
        run = F.slice(s, a + 1, end - a)
        return F.struct((k + 1).alias("no"), F.get(s, a)["speaker"].alias("speaker"), F.array_join(F.transform(run, lambda x: x["speech"]), " ").alias("speech"))

    return F.transform(starts, turn)


def minutes(documents: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """The transcripts of both tables, one row per (doc_id, source) or chunk, with the meeting and committee of chunks.
    Repeated rows of a document keep the text fetched last (ties: the greater text)."""
    docs = (
        documents.where(F.col("source").startswith("minutes_") & F.col("full_text").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id", "source")
        .agg(F.max(F.struct("fetched_at", "full_text")).alias("m"))
        .select(F.lit("document_text").alias("item_table"), "doc_id", "source", F.col("m.full_text").alias("text"))
    )
    if chunks is None:
        return docs
    sub = F.regexp_replace(F.lower(F.trim("sub_source")), r"[\s-]+", "_")
    return docs.withColumns({"meeting": F.col("doc_id"), "committee": F.lit(None).cast("string")}).unionByName(
        chunks.where(sub.startswith("minutes_") & F.col("text").isNotNull() & F.col("chunk_id").isNotNull())
        .groupBy(F.col("chunk_id").alias("doc_id"), sub.alias("source"))
        .agg(F.max(F.struct("text", F.col("doc_id").alias("meeting"), "committee")).alias("m"))
        .select(F.lit("chunks").alias("item_table"), "doc_id", "source", "m.text", "m.meeting", "m.committee")
    )
