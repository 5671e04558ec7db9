import datetime as dt
import pickle
import random
import re

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orrery.llm import assign, counts, p1_turns, p2_furniture, p3_scans, p4_neighbours, p5_copies, p7_split, p8_leaks, p9_mix, p10_encoding, queries, tokens
from orrery.session import table

CLASH = "n hist key k1 k2 _salt salt rn vh p whole block tokens cell line article part members keep g cut turn_no who pair blk same".split()
TABLES = {
    "p1": (lambda a: p1_turns.turns(p1_turns.minutes(a)), "document_text"),
    "p2": (p2_furniture.found, "news_articles"),
    "p4": (p4_neighbours.found, "chunks"),
    "p5": (p5_copies.found, "news_articles"),
    "p5c": (p5_copies.collapsed, "news_articles"),
    "p10": (p10_encoding.repairs, "documents"),
}


@pytest.mark.parametrize("name", TABLES)
def test_empty_and_clashing_tables(spark, sf, empty_like, clashing, name):
    run, tab = TABLES[name]
    assert run(empty_like(tab, extra=CLASH)).count() == 0
    df = table(spark, sf, tab)
    odd = clashing(df, *[c for c in CLASH if c not in df.columns])
    assert sorted(map(str, run(odd).collect())) == sorted(map(str, run(df).collect()))


def test_empty_pairs_of_tables(spark, sf, empty_like, clashing):
    docs, items, mix = (table(spark, sf, t) for t in ("documents", "bench_items", "mix_targets"))
    assert p8_leaks.leaks(empty_like("documents"), items).count() == 0 and p8_leaks.leaks(docs, empty_like("bench_items")).count() == 0
    assert p9_mix.mix(empty_like("documents"), mix).count() == 0 and p9_mix.mix(docs, empty_like("mix_targets")).count() == 0
    assert p9_mix.shares(p9_mix.mix(empty_like("documents"), mix), mix).count() == 11
    odd, odd_items = clashing(docs, "n", "p", "block", "tokens", "whole"), clashing(items, "n")
    assert sorted(p8_leaks.leaks(odd, odd_items).collect()) == sorted(p8_leaks.leaks(docs, items).collect())
    assert sorted(p9_mix.mix(odd, clashing(mix, "p", "whole")).collect()) == sorted(p9_mix.mix(docs, mix).collect())
    e = lambda t: empty_like(t)
    assert p7_split.pieces(p7_split.items(e("bill_text"), e("document_text"), e("chunks"))).count() == 0
    assert p3_scans.disturbed(p3_scans.items(e("bill_text"), e("document_text"))).count() == 0
    assert p3_scans.paragraphs(p3_scans.items(clashing(table(spark, sf, "bill_text"), "n", "kind", "text"), clashing(table(spark, sf, "document_text"), "n", "text"))).count() > 0


def test_queries_are_registered():
    q = queries.queries()
    assert set(queries.oracle_sql()) <= set(q) and all(any(k.startswith(f"p{n}_") for k in q) for n in (1, 2, 3, 4, 5, 7, 8, 9, 10))


# -- p1 -----------------------------------------------------------------------------------------------------------


def turns_of(spark, text, source="minutes_plenary"):
    df = spark.createDataFrame([("document_text", "d", source, text)], "item_table string, doc_id string, source string, text string")
    return [(r.speaker, r.speech) for r in p1_turns.turns(df).orderBy("turn_no").collect()]


def test_label_forms(spark):
    text = "제1회 보건위원회 회의록\n말 없음\n<김가나 위원장>\n시작합니다.\n[00:01:02] ● 이다라위원 ― 음, 질문합니다.\n(웃음)\n◯위원장 답하십시오.\n이위원: 어…\n○박마바 장관 [10시 3분] 답합니다.\n정사아： 그 뭐 또 있습니다.\n의원(최자차) 끝.\n한 카 타 차관: 네 그렇습니다.\n◯의원 최자차  더.\n[한카타] 더."
    assert turns_of(spark, text) == [("김가나", "시작합니다."), ("이다라", "질문합니다."), ("김가나", "답하십시오."), ("박마바", "답합니다."), ("정사아", "또 있습니다."), ("최자차", "끝."), ("한카타", "네 그렇습니다."), ("최자차", "더."), ("한카타", "더.")]


def test_turns_merge_over_silence(spark):
    text = "김가나 위원: 하나\n이다라 위원: (박수)\n김가나 위원: 둘\n00:01:02.345\n셋"
    assert turns_of(spark, text) == [("김가나", "하나 둘 셋")]
    assert turns_of(spark, "") == [] and turns_of(spark, "말만 있음") == [] and turns_of(spark, None) == []
    assert len(turns_of(spark, "김가나 위원: 하나\n이다라 위원: 둘\n" * 3000)) == 6000


def test_cross_transcript_roster(spark):
    other = "보건위원회\n" + "김가나 위원장: 말\n" * 3
    rows = [("document_text", f"o{i}", "minutes_plenary", other) for i in range(2)] + [("document_text", "d", "minutes_plenary", "보건위원회\n◯위원장 말씀\n최위원: 네"), ("document_text", "e", "minutes_plenary", "재정위원회\n◯위원장 말씀")]
    df = spark.createDataFrame(rows, "item_table string, doc_id string, source string, text string")
    got = {(r.doc_id, r.turn_no): r.speaker for r in p1_turns.turns(df).collect()}
    assert got["d", 1] == "김가나" and got["d", 2] == "최" and got["e", 1] == "위원장"


def test_chunks_take_the_roster_of_their_transcript(spark):
    whole = "보건위원회\n김가나 위원장: 하나\n김다라 위원장: 둘\n이마바 위원: 셋\n" + "긴 말\n" * 200
    docs = [("d", "minutes_plenary", whole, 1), ("e", "minutes_plenary", "◯위원장 말씀", 1)]
    d = spark.createDataFrame(docs, "doc_id string, source string, full_text string, fetched_at int")
    cuts = [("c1", "이위원: 넷", "d", "보건위원회"), ("c2", "김다라 위원장: 다섯\n위원: 여섯", "d", None), ("c3", "◯위원장 말씀", "x", "보건위원회"), ("c4", "◯위원장 말씀", None, None)]
    c = spark.createDataFrame(cuts, "chunk_id string, text string, doc_id string, committee string").withColumn("sub_source", F.lit("Minutes plenary"))
    got = {(r.item_table, r.doc_id, r.turn_no): r.speaker for r in p1_turns.turns(p1_turns.minutes(d, c)).collect()}
    assert got["chunks", "c1", 1] == "이마바" and got["chunks", "c2", 2] == "이마바"
    assert got["chunks", "c3", 1] in ("김가나", "김다라")  # by its committee
    assert got["document_text", "e", 1] == got["chunks", "c4", 1] == "위원장"  # of no known committee


def test_roster_keeps_every_candidate(spark):
    known = [("보건위원회", "가가나 위원", 1), ("보건위원회", "김다라 위원", 3), ("보건위원회", "김가나 위원", 2), ("보건위원회", "김다라 의원", 3)]
    rows = [("document_text", f"{lab}{i}", "minutes_plenary", f"{lab}: 말\n" + "긴 말\n" * 200 + f"{body} 회의") for body, lab, n in known for i in range(n)]
    rows.append(("document_text", "d", "minutes_plenary", "보건위원회\n김위원: 하나\n김의원: 둘"))
    df = spark.createDataFrame(rows, "item_table string, doc_id string, source string, text string")
    got = {r.turn_no: r.speaker for r in p1_turns.turns(df).where("doc_id = 'd'").collect()}
    assert got == {1: "김가나", 2: "김다라"}


def test_spellings_across_transcripts(spark):
    right = "보건위원회\n김가나 위원장: 말\n이다라 위원: 말"
    rows = [("document_text", f"o{i}", "minutes_plenary", right) for i in range(4)]
    rows.append(("document_text", "d", "minutes_plenary", "보건위원회\n김가냐 위원장: 하나\n◯위원장 둘\n이다라 위원: 셋"))  # one sound off, in this transcript alone
    rows.append(("document_text", "e", "minutes_plenary", "보건위원회\n김가나 위원장: 하나\n김기나 위원장: 둘"))  # beside the person it might spell
    rows.append(("document_text", "f", "minutes_plenary", "재정위원회\n김거나 위원장: 하나"))  # of another committee
    rows.append(("document_text", "g", "minutes_plenary", "보건위원회\n◯위원장 하나"))  # two chairs: the one seen more often
    df = spark.createDataFrame(rows, "item_table string, doc_id string, source string, text string")
    got = {(r.doc_id, r.turn_no): r.speaker for r in p1_turns.turns(df).collect()}
    assert got["d", 1] == "김가나" and ("d", 3) not in got and got["d", 2] == "이다라"
    assert got["e", 2] == "김기나" and got["f", 1] == "김거나" and got["g", 1] == "김가나"


def test_offices_are_learned(spark):
    text = "김가나 총리: 하나\n이다라 총리: 둘\n◯총리 셋\n박마바 총리: 넷\n남궁민수 위원: 다섯\n김훈 위원: 여섯\n최사아 말로는: 일곱"
    assert p1_turns.offices(spark.createDataFrame([(text,)], "text string")) == (*p1_turns.ROLES, "총리")
    got = [s for s, _ in turns_of(spark, text)]
    assert got[:2] == ["김가나", "이다라"] and got[-3:] == ["박마바", "남궁민수", "김훈"]


def test_least_cost():
    rng = np.random.default_rng(0)
    from itertools import combinations, permutations

    for _ in range(80):
        n, m = map(int, rng.integers(1, 5, 2))
        c = rng.integers(0, 9, (n, m)).astype(float)
        got, k = assign.least_cost(c), min(n, m)
        assert len(got) == k
        assert sum(c[i, j] for i, j in got) == min(sum(c[i, j] for i, j in zip(r, q)) for r in combinations(range(n), k) for q in permutations(range(m), k))


def test_phonetic_spelling_variants():
    assert p1_turns.phonetic("김새봄") == p1_turns.phonetic("김세봄") != p1_turns.phonetic("김사봄")
    r = p1_turns.roster([("김새봄", "위원")] * 3 + [("김세봄", "")])
    assert set(r) == {"김새봄"} and p1_turns.assign([("김세봄", "")], r) == {("김세봄", ""): "김새봄"}


# -- p2, p5 -------------------------------------------------------------------------------------------------------

NEWS = "news_id string, provider string, content string, ingested_at timestamp_ntz"


def news(spark, rows):
    return spark.createDataFrame([(i, p, c, dt.datetime(2020, 1 + (k % 2), 1)) for k, (i, p, c) in enumerate(rows)], NEWS)


def test_line_keys():
    k = p2_furniture.line_key
    assert k("▶ 제보 전화 02-123-4567") == k("제보전화 031.9.1") != k("제보 문의 1")
    assert k("하루일보 김가나 기자 a.b@c.d") == k("하루일보 박다라기자 zz@c.d")
    assert k("Reporting by Ann Lee; editing by Bo Ek") == k("REPORTING BY C D; EDITING BY E F.")
    assert k(" ― * ― ") == "" and k("") == ""


def test_furniture_against_brute_force(spark, sf):
    df = table(spark, sf, "news_articles")
    rows = [(r.news_id, (r.provider or "").strip().lower(), r.content or "") for r in df.collect() if r.news_id]
    art, seen = {}, {}
    for i, p, c in rows:
        art.setdefault(p, set()).add((p5_copies.keys(c) or (0, i))[1])
        for line in c.split("\n"):
            if w := p2_furniture.line_key(line):
                seen.setdefault((p, w), set()).add((p5_copies.keys(c) or (0, i))[1])
    hot = {k for k, v in seen.items() if len(v) >= 3 and len(v) >= 0.05 * len(art[k[0]])}
    want = {(i, n) for i, p, c in rows for n, line in enumerate(c.split("\n"), 1) if (p, p2_furniture.line_key(line)) in hot}
    assert {tuple(r) for r in p2_furniture.found(df).collect()} == want


def test_increments_equal_the_whole(spark):
    def recount(rows):
        """Brute force over all rows, articles being the groups of problem 5."""
        df = news(spark, [r[:3] for r in rows])
        keep = {r.news_id: r.keep for r in p5_copies.groups(df).collect()}
        held, every = {}, {}
        for i, p, c, _ in rows:
            every.setdefault(p, set()).add(keep.get(i, i))
            for line in c.split("\n"):
                if w := p2_furniture.line_key(line):
                    held.setdefault((p, w), set()).add(keep.get(i, i))
        over = {k for k, v in held.items() if len(v) >= 3 and len(v) >= 0.05 * len(every[k[0]])}
        return {(i, n) for i, p, c, _ in rows for n, line in enumerate(c.split("\n"), 1) if (p, p2_furniture.line_key(line)) in over}

    rare = "\n드문 줄"
    rows = [(f"n{i}", "p", f"글 {chr(0xAC00 + i)}\n광고 {i}" + (rare if i in (0, 3, 6) else ""), i % 3) for i in range(70)]
    rows += [(f"c{i}", "p", f"글  {chr(0xAC00 + i)}!\n광고 {i}" + rare, 2) for i in (0, 3, 6)]  # copies that arrive later
    # One article in three layouts, of which the last alone links the first two; two more bring its line over the threshold.
    rows += [("x1", "q", "가: 나\n다: 라", 0), ("x2", "q", "다: 라 가: 나", 1), ("x3", "q", "다: 라\n가: 나", 2), ("x4", "q", "글\n가: 나", 1), ("x5", "q", "말\n가: 나", 2)]
    rows += [(f"d{i}", "r", f"{chr(0xAC00 + i)}\n뜨는 줄" if i > 5 else f"{chr(0xAC00 + i)}", 0 if i < 7 else 1) for i in range(9)]
    want = recount(rows)
    assert ("n0", 3) not in want and ("x4", 2) in want and ("d6", 2) in want
    for order in ((0, 1, 2), (2, 1, 0), (1, 0, 2)):
        state, touched = p2_furniture.Counts(spark), []
        for k in order:
            touched.append({r.news_id for r in state.add(news(spark, [r[:3] for r in rows if r[3] == k])).collect()})
        assert {tuple(r) for r in state.hits().collect()} == want
        if order == (0, 1, 2):  # d6 is marked again when its line crosses, n0 when its line falls; n9 stays as it is
            assert ("n0", 3) in recount([r for r in rows if r[3] == 0])
            assert "d6" in touched[1] and "n0" in touched[1] | touched[2] and "n9" not in touched[1] | touched[2]
    df = news(spark, [r[:3] for r in rows])
    assert {tuple(r) for r in p2_furniture.found(df).collect()} == want
    out = {r.news_id: r.content for r in p2_furniture.rebuild(df, p2_furniture.found(df)).collect()}
    assert out["n4"] == "글 간" and "x1" in out
    again = p2_furniture.rebuild(df, p2_furniture.found(df), spark.createDataFrame([("n4",), ("d0",)], "news_id string"))
    assert sorted(tuple(r) for r in again.collect()) == [("d0", "가", 0), ("n4", "글 간", 1)]


def test_copies_over_chains_of_layouts(spark):
    rows, want, links = [], set(), {-1: 0, 1: 0}
    for k in range(12):
        a, b, c, d = (f"{w}: {v}{k}" for w, v in zip("갑을병정", "가나다라"))
        # run together / in other lines / in other orders: each agrees with its neighbours only
        chain = [f"{a}\n{b}\n{c}\n{d}", f"{a} {b} {c} {d}", f"{a} {b}\n{c}\n{d}", f"{d}\n{a} {b}\n{c}", f"{d} {a} {b} {c}", f"{d}\n{a}\n{b} {c}", f"{b} {c}\n{a}\n{d}", f"{b}\n{a}\n{d}\n{c}"]
        rows += [(f"{k:02}{i}", "p", x) for i, x in enumerate(chain)]
        want |= {(f"{k:02}0", f"{k:02}{i}") for i in range(1, len(chain))}
        links[1 if p5_copies.keys(chain[0])[1] < p5_copies.keys(chain[1])[1] else -1] += 1
    rows += [("x1", "p", "가: 나\n다: 라"), ("x2", "p", "다: 라\n가: 나"), ("y1", "p", "마: 바"), ("y2", "p", "바마")]
    assert min(links.values()) > 0  # digests in both orders
    assert {tuple(r) for r in p5_copies.found(news(spark, rows)).collect()} == want | {("x1", "x2")}


def test_copies(spark):
    f = "주제: 가\n장소: 나\n일시: 다"
    rows = [("1", "P", "가 나 1,2"), ("2", " p", "가나 12!"), ("3", "q", "가나12"), ("4", "p", "나가12"), ("5", "p", f), ("6", "p", "장소: 나\n일시: 다\n주제 : 가"), ("7", "p", "가 주제: 장소: 나 일시: 다"), ("8", "p", ""), ("9", "p", "!!"), ("9", "p", None), (None, "p", "가나12"), ("1", "P", "가 나 1,2"), ("5b", "p", f.replace("\n", " "))]
    got = sorted(tuple(r) for r in p5_copies.found(news(spark, rows)).collect())
    assert got == [("1", "2"), ("5", "5b"), ("5", "6")]
    swapped = [("a", "p", "Registration deadline: 1\nIssue date: 2"), ("b", "p", "Issue date: 2\nRegistration deadline: 1"), ("c", "p", "Issue date 1\nRegistration deadline: 2"), ("d", "p", "12:30\n가: 나"), ("e", "p", "가: 나\n12:30")]
    assert {tuple(r) for r in p5_copies.found(news(spark, swapped)).collect()} == {("a", "b")}
    c = {r.news_id: r.copies for r in p5_copies.collapsed(news(spark, rows)).collect()}
    assert c["1"] == 2 and c["5"] == 3 and c["4"] == 1 and c["8"] == 1


def test_hot_group_of_copies(spark, monkeypatch):
    monkeypatch.setattr(p5_copies.salted_join, "__defaults__", (500, 8))
    df = news(spark, [(f"{i:05d}", "p", "같은 글" + "!" * (i % 3)) for i in range(3000)])
    got = p5_copies.found(df)
    assert got.count() == 2999 and got.select("news_id_keep").distinct().collect()[0][0] == "00000"


# -- p3 -----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def grams():
    text = "감독기관은 사례를 분석해 기본계획을 의무화하기로 했다. 정부는 안전성을 검토하기로 했다. 공공기관은 지난 5월 15일 의견을 모았다. the council shall publish safety rules for all firms. AI 기반\n" * 60
    return grams_of([text])


def grams_of(texts):
    keys = p3_scans.packed(texts)
    k, n = np.unique(np.concatenate([keys & k for k in p3_scans._KEEP]), return_counts=True)
    keep = n >= max(2, len(keys) * p3_scans.SHARE)
    return p3_scans.Grams(k[keep], n[keep].astype(float), float(len(keys)))


def test_decode(grams):
    for read, printed in (("정부는 얀전성을 검토하7|로 했다.", "정부는 안전성을 검토하기로 했다."), ("콩공기관은 즤난 S월 l5일 의견욜 모았다.", "공공기관은 지난 5월 15일 의견을 모았다."), ("thc council shal1 publish safcty rules f0r all firrns.", "the council shall publish safety rules for all firms."), ("감독■기관은 샤례를 분¦석해", "감독기관은 사례를 분석해"), ("A| 기반", "AI 기반")):
        assert p3_scans.decode(grams, read) == printed and p3_scans.decode(grams, printed) == printed


def test_confusions_are_learned():
    """A glyph that no table lists is learned from its even rate, and corrected; letters that language swaps are not."""
    rng = random.Random(6)
    stems = ["".join(chr(0xAC00 + rng.randrange(11172)) for _ in range(2)) for _ in range(20)]
    ends = ["가는", "나가", "다가서", "에게", "라고", "들이", "마저"]
    texts = []
    for _ in range(400):
        line = " ".join(rng.choice(stems) + rng.choice(ends) for _ in range(60))
        texts.append("".join("갸" if ch == "가" and rng.random() < 0.03 else ch for ch in line))
    g = grams_of(texts)
    assert list(g.confusions) == ["갸"] and g.confusions["갸"][0][0] == "가" and abs(g.confusions["갸"][0][1] - 0.03) < 0.01
    s = f"{stems[0]}갸는 {stems[1]}나갸"
    assert p3_scans.decode(g, s) == s.replace("갸", "가") and p3_scans.decode(g, s.replace("갸", "가")) == s.replace("갸", "가")
    # The corpus three times over and mixed with other scripts shows the same confusion.
    other = [" ".join("".join(chr(a + rng.randrange(30)) for _ in range(5)) for _ in range(60)) for a in (0x410, 0x391, 0x5D0, 0x627, 0x905, 0xE01, 0x10D0, 0x531, 0x3041, 0x30A1)]
    assert {k: v[0][0] for k, v in grams_of(texts * 3 + other * 10).confusions.items()} == {"갸": "가"}


def test_page_furniture(grams):
    lines = "가나 관리에 관한 법률안\n의안번호 12\n정부는 안전성을 검토하-\n- 1 -\n\x0c가나 관리에 관한 법률안 (초안)\n기로 했다.\n사례를 분석해\n가나 관리에 관힌 법률안 (초안)     2\n끝.\n15".split("\n")
    found, text = p3_scans.analyse(grams, "\n".join(lines))
    assert set(found) == {(3, "split_word"), (4, "page_no"), (5, "running"), (8, "running"), (8, "page_no"), (10, "page_no")}
    assert "검토하기로 했다." in text and "초안" not in text and "15" not in text
    assert p3_scans.analyse(grams, "") == ([], "") and p3_scans.analyse(grams, "\n\n") == ([], "")
    clean = "정부는 안전성을 검토하기로 했다.\n\n둘째 문단"
    assert p3_scans.analyse(grams, clean) == ([], clean)
    assert len(p3_scans.analyse(grams, "정부는 안전성을 검토하기로 했다. " * 3000)[1]) > 50_000


def test_split_word_with_misread_half(grams):
    found, text = p3_scans.analyse(grams, "제목 없는 글이다\n정부는 안전성을 검토¬\n하7|로 했다.")
    assert found == [(2, "split_word"), (3, "misread")] and "검토하기로 했다." in text


# -- p4 -----------------------------------------------------------------------------------------------------------


def brute(ids, x):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 6)
    out = set()
    for i in range(len(ids)):
        order = sorted((j for j in range(len(ids)) if j != i), key=lambda j: (-s[i, j], ids[j]))[:5]
        out |= {tuple(sorted((ids[i], ids[j]))) for j in order if s[i, j] >= 0.85}
    return out


def test_neighbours_recall_and_copies(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 64))
    x = np.concatenate([c + rng.normal(size=(12, 64)) * rng.uniform(0.05, 0.45) for c in centres]).astype(np.float32)
    x[7:19] = x[7]  # twelve copies: more than anyone's five nearest
    ids = [f"c{i:04d}" for i in rng.permutation(len(x))]
    bad = [("z1", None), ("z2", [0.0] * 64), ("z3", [float("nan")] * 64), ("z4", [1.0] * 63), (None, [1.0] * 64), ("z5", [None] * 64)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + bad + [(ids[0], x[0].tolist())], "chunk_id string, vector array<float>")
    got, want = {tuple(r) for r in p4_neighbours.found(df).collect()}, brute(ids, x.astype(float))
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.05 * len(want)
    copies = {tuple(sorted((ids[i], ids[j]))) for i in range(7, 19) for j in range(7, 19) if i < j}
    assert copies & want <= got


def test_split_buckets_give_the_same(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=64) + rng.normal(size=(120, 64)) * 0.05
    df = spark.createDataFrame([(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)], "chunk_id string, vector array<float>")
    whole = sorted(map(str, p4_neighbours.neighbours(df).collect()))
    monkeypatch.setattr(p4_neighbours, "BUCKET", 7)
    assert sorted(map(str, p4_neighbours.neighbours(df).collect())) == whole


# -- p7 -----------------------------------------------------------------------------------------------------------


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab가 .,\ń😀", max_size=400), st.integers(8, 60), st.integers(0, 7))
def test_pieces_cover_the_text(text, limit, overlap):
    c = p7_split.cuts(text, limit, overlap)
    if not text:
        assert c == []
        return
    assert c[0][0] == 0 and c[-1][1] == len(text) and all(0 < b - a <= limit for a, b in c)
    mark = lambda i: bool(p7_split._MARKS.match(text[i]))
    assert all(s <= max(0, e - overlap) and f > e for (_, e), (s, f) in zip(c, c[1:]))
    assert all(s == max(0, e - overlap) or not mark(s) and all(mark(i) for i in range(s + 1, e - overlap + 1)) for (_, e), (s, _) in zip(c, c[1:]))
    if len(text) > limit:  # the doubled table gives what a walk from left to right gives
        ends, succ = p7_split.successors(text, limit, overlap)
        i, walk = 0, []
        while ends[i] < len(text):
            walk.append(int(ends[succ[i]]))
            i = succ[i]
        assert [e for _, e in c] == walk


def test_repeated_items(spark):
    df = spark.createDataFrame([("chunks", "a", "x" * 1600)] * 2 + [("chunks", "a", "y"), ("chunks", None, "z"), ("chunks", "b", None), ("chunks", "c", "")], "item_table string, item_key string, text string")
    assert sorted((r.item_key, r.piece_no, r.start, r.end) for r in p7_split.pieces(df).collect()) == [("a", 1, 0, 1), ("a", 1, 0, 1500), ("a", 2, 1300, 1600)]
    assert [tuple(r) for r in p7_split.found(df).collect()] == [("chunks", "a")]


def test_natural_cuts():
    text = ("가나다 라마바. " * 60 + "\n\n") * 4
    ends = [e for _, e in p7_split.cuts(text)][:-1]
    assert all(text[e - 1] in " \n" for e in ends)
    assert [e for _, e in p7_split.cuts("x" * 4000)] == [1500, 2800, 4000]
    with pytest.raises(ValueError):
        p7_split.pieces(None, 10, 10)


# -- p8 -----------------------------------------------------------------------------------------------------------


def wordlist(rng, n):
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 9))) for _ in range(n)]


def test_leaks(spark):
    rng = random.Random(2)
    words = wordlist(rng, 400)
    make = lambda n: [rng.choice(words) for _ in range(n)]
    items = [make(40) for _ in range(20)]
    docs, want = [], set()

    def doc(mid, *leaks):
        docs.append((len(docs), " ".join(make(50)) + " " + mid + " " + " ".join(make(50))))
        want.update((len(docs) - 1, i) for i in leaks)

    for i, w in enumerate(items):
        doc(" ".join(w), i)
        doc(",\n".join(w).upper(), i)
        doc(" ".join("zzzz" if k % 9 == 4 else x for k, x in enumerate(w)), i)
        part = w[5:30] if len("".join(w[5:30])) >= 125 else w
        doc("".join(part), i)
        short = w[:10]
        assert len("".join(short)) < 115
        doc(" ".join(short))
        doc(" ".join(w[::-1]))
    docs.append((len(docs), ""))
    table_of = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    rows = list(enumerate(map(" ".join, items)))
    got = {tuple(r) for r in p8_leaks.leaks(table_of(docs, "doc_id"), table_of(rows + [(99, "short"), (None, "x"), (98, None)], "item_id")).collect()}
    assert got == want
    # Many more items change nothing for these, and the plan of the training seeds stays one scan.
    other = random.Random(9)
    more = rows + [(1000 + k, " ".join(wordlist(other, 40))) for k in range(3000)]
    assert {tuple(r) for r in p8_leaks.leaks(table_of(docs, "doc_id"), table_of(more, "item_id")).collect()} == want


def test_recall_at_changed_words(spark):
    """Against passages that hold by construction: every word at a random place of each group of k is changed."""
    rng = random.Random(5)
    words = wordlist(rng, 900)
    for k, least in ((8, 1.0), (6, 0.97)):
        items = [[rng.choice(words) for _ in range(60)] for _ in range(60)]
        docs = []
        for i, w in enumerate(items):
            changed = list(w)
            for g in range(0, len(w), k):
                changed[min(g + rng.randint(1, k - 2), len(w) - 1)] = rng.choice(["of", "perhaps", "notwithstanding"])
            docs.append((i, " ".join(changed)))
        got = p8_leaks.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")).collect()
        assert all(r.doc_id == r.item_id for r in got) and len(got) >= least * len(items)


def test_heavy_seeds_give_the_same(spark, monkeypatch):
    text = " ".join(wordlist(random.Random(1), 60))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string")
    items = spark.createDataFrame([(1, text), (2, text + " more")], "item_id long, text string")
    monkeypatch.setattr(p5_copies.salted_join, "__defaults__", (50, 4))
    monkeypatch.setattr(p8_leaks, "BROADCAST_SEEDS", 10)
    assert p8_leaks.leaks(docs, items).count() == 600


# -- p9 -----------------------------------------------------------------------------------------------------------


def test_token_counts_do_not_hang_on_length():
    enc = tokens.encoding(*tokens.vocabulary())
    rng = random.Random(2)
    for text in ("", "가 나", " ".join(rng.choice(["가나다", "word", " x", "12,5", "\n\n", "é!"]) for _ in range(400)), "x" * 300, "가" * 50 + "  " + "b c" * 90):
        assert all(tokens.count(enc, text, part) == len(enc.encode_ordinary(text)) for part in (1, 7, 40, 100_000))


def test_flight_keeps_the_balance():
    rng = random.Random(0)
    for _ in range(30):
        n = rng.randint(0, 60)
        p, t = [rng.random() for _ in range(n)], [rng.randint(1, 500) for _ in range(n)]
        q = p9_mix.flight(p, t, rng)
        assert sum(0 < x < 1 for x in q) <= 2 and sum(q) == pytest.approx(sum(p), abs=1e-6) and sum(a * b for a, b in zip(q, t)) == pytest.approx(sum(a * b for a, b in zip(p, t)), rel=1e-9, abs=1e-5)
        assert all(x in (0.0, 1.0) for x in p9_mix.landing(q, t))


def test_inclusion_is_unbiased():
    rng = random.Random(1)
    hits = np.zeros(12)
    for _ in range(4000):
        hits += p9_mix.flight([0.3] * 12, [5, 9, 2, 7, 7, 7, 1, 3, 8, 4, 6, 2], rng)
    assert np.abs(hits / 4000 - 0.3).max() < 0.04


def test_mix_reaches_the_shares(spark):
    rng = random.Random(3)
    word = lambda n: " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(n))
    docs = [(i, word(rng.randint(5, 80)), s) for i, s in enumerate(["kr-a"] * 500 + [" KR_A"] * 100 + ["b"] * 60 + ["unlisted"] * 20 + [None] * 5)] + [(9001, "", "b"), (9002, None, "b")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("kr_a", 0.6, 2), ("b", 0.3, 4), ("gone", 0.1, 3)], "source string, target_share double, max_repeats int")
    for block in (16, 4096):
        m = p9_mix.mix(df, targets, block=block).collect()
        tot = {s: sum(r.repeats * r.tokens for r in m if r.source == s) for s in ("kr_a", "b")}
        assert tot["kr_a"] / sum(tot.values()) == pytest.approx(0.6 / 0.9, abs=0.01)
        assert max(r.repeats for r in m if r.source == "b") <= 4 and max(r.repeats for r in m if r.source == "kr_a") <= 2
        assert len({r.doc_id for r in m}) == len(m) and not {r.doc_id for r in m} & {9001, 9002} and {r.source for r in m} == {"kr_a", "b"}
    s = {r.source: r for r in p9_mix.shares(p9_mix.mix(df, targets), targets).collect()}
    assert s["gone"].actual_share == 0 and s["b"].documents == 60


# -- p10 ----------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def pairs():
    rng = random.Random(4)
    ko = "담당 위원회는 이용약관을 시급히 개선하기로 했다는 설명이다 현행 제도는 통계가 없고 반도체 예산을 공개했다".split()
    eu = "für die Prüfung naïve café Piñola’s règlement déposé à l’été — “light” § 5 €9 über Straße größer".split()
    texts = [" ".join(rng.choice(w) for _ in range(60)) for w in (ko, eu, ko + eu) for _ in range(150)]
    return pairs_of(texts), texts, rng


def pairs_of(texts):
    t = pd.concat(p10_encoding._count([pd.DataFrame({"text": texts})])).groupby("key")["n"].sum()
    chars = t.groupby(t.index.to_numpy() >> 21).sum()
    return p10_encoding.Pairs(t.index.to_numpy(), t.to_numpy(), chars.index.to_numpy(), chars.to_numpy())


WRONG = [("utf-8", "latin-1"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp949", "latin-1")]


@pytest.mark.parametrize("right,wrong", WRONG)
def test_round_trips(pairs, right, wrong):
    p, texts, rng = pairs
    ok = tried = 0
    for t in texts[:40] if right == "cp949" else texts[:40] + texts[160:200]:
        w = t.split()
        at = rng.randrange(len(w) - 12)
        bit = " ".join(w[at : at + 12])
        try:
            bad = bit.encode(right).decode(wrong)
        except UnicodeError:
            continue
        if bad == bit:
            continue
        tried += 1
        fixed, good, lost = p10_encoding.repaired(p, " ".join([*w[:at], bad, *w[at + 12 :]]))
        assert good or lost
        ok += fixed == t
    assert tried > 10 and ok >= 0.8 * tried


def test_hangul_from_two_bytes(pairs):
    p, texts, _ = pairs
    for t in texts[150:170]:
        w = t.split()
        w[5:9] = ["größer", "für", "naïve", "à"]
        bad = list(w)
        bad[5:9] = [x.encode().decode("cp949") for x in w[5:9]]
        assert all("가" <= c <= "힣" for x in bad[5:9] for c in x if not c.isascii())
        fixed, good, lost = p10_encoding.repaired(p, " ".join(bad))
        assert fixed == " ".join(w) and good and not lost  # among correct umlauts, with no other sign
    ko = "담당 체 위원회는 철 커 하기로 IT커 뮤 이용약관을"
    assert p10_encoding.repaired(p, ko) == (ko, 0, 0)


@pytest.mark.parametrize("wrong", ["latin-1", "cp1252", "mac_roman"])
def test_scripts_the_corpus_hardly_has(pairs, wrong):
    p, _, _ = pairs
    done = 0
    for text in ("Правительство предложило новый закон", "Η κυβέρνηση πρότεινε νέο νόμο", "政府提出了新的法律"):
        try:
            bad = text.encode().decode(wrong)
        except UnicodeError:
            continue
        done += 1
        assert p10_encoding.repaired(p, "see: " + bad)[0] == "see: " + text
        assert p10_encoding.repaired(p, "see: " + text)[0] == "see: " + text
    assert done or wrong == "cp1252"


def test_other_scripts_in_the_corpus_change_nothing(spark):
    """The corpus repeated, and mixed with texts of ten other scripts, gives the same findings."""
    rng = random.Random(8)
    scripts = [(0x410, 32), (0x391, 24), (0x5D0, 27), (0x627, 36), (0x905, 53), (0xE01, 46), (0x10D0, 33), (0x531, 38), (0x1200, 200), (0x4E00, 3000)]
    word = lambda a, n: "".join(chr(a + rng.randrange(n)) for _ in range(4))
    other = [(100_000 + i, " ".join(word(*scripts[i % 10]) for _ in range(40))) for i in range(400)]
    ko = "담당 위원회는 이용약관을 시급히 개선하기로 했다는 설명이다 현행 제도는 통계가 없고 반도체 예산을 공개했다 für größer à".split()
    own = []
    for i in range(400):
        w = [rng.choice(ko) for _ in range(30)]
        own.append((i, " ".join(w if i % 20 else w[:10] + [x.encode().decode("latin-1") for x in w[10:16]] + w[16:])))
    df = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    found = lambda rows: {(r.doc_id, r.text) for r in p10_encoding.repairs(df(rows)).collect() if r.doc_id < 400}
    alone = found(own)
    assert {d for d, _ in alone} == set(range(0, 400, 20))
    assert found(own + [(d + 1000 * k, t) for k in range(1, 4) for d, t in own] + other) == alone


def test_exact_counts():
    rng = np.random.default_rng(3)
    keys = np.unique(rng.integers(-(2**62), 2**62, 50_000))
    n = rng.integers(1, 1000, len(keys))
    t = pickle.loads(pickle.dumps(counts.Table(keys, n)))
    assert (t.get(keys) == n).all() and (t.get(keys + 1)[~np.isin(keys + 1, keys)] == 0).all() and counts.Table(keys[:0], n[:0]).get(keys).sum() == 0
    parts = pd.concat(counts.tallied([keys[:7], keys[:9], keys[3:4]], limit=10)).groupby("key")["n"].sum()
    assert parts[keys[3]] == 3 and parts[keys[8]] == 1


def test_correct_texts_stay(pairs):
    p, texts, _ = pairs
    for t in texts:
        assert p10_encoding.repaired(p, t) == (t, 0, 0)
    for t in ("", "a", "é", "ascii only", "┌──┬──┐\n│가│나│\n└──┴──┘", "ㅋㅋ ㅠㅠ 🙂 ½ ± µ", "¿Qué? ¡No! «Oui»", "大臣 李成 奏議 法律"):
        assert p10_encoding.repaired(p, t) == (t, 0, 0)
    assert p10_encoding.repaired(p, "canno� be had")[1:] == (0, 1)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-3, 3).filter(lambda x: abs(x) > 1e-3), max_size=14))
def test_segments(xs):
    def slow(a, b):
        best = max(((sum(xs[i:j]), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=None)
        if best is None or best[0] <= 1e-9:
            return []
        return slow(a, best[3]) + [best[3:]] + slow(best[4], b)

    got, want = p10_encoding.segments(np.array(xs)), slow(0, len(xs))
    assert sum(sum(xs[a:b]) for a, b in got) == pytest.approx(sum(sum(xs[a:b]) for a, b in want))


def test_names_stay_out():
    """The subpackage is a leaf: nothing outside imports it but the driver's entry."""
    import pathlib

    root = pathlib.Path(queries.__file__).parents[1]
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and re.search(r"orrery\.llm|from \.llm", p.read_text())]
