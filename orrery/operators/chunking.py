"""Deterministic chunks of bills, cards, documents, speeches and members."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.functions.text import digest16

# Fixed values of the chunking rules.
WHOLE, SIZE, OVERLAP = 1500, 800, 200
STEP = SIZE - OVERLAP
_MARK = re.compile("◯[^\n]{0,40}")


def windows(text: Column) -> Column:
    """Array of (idx, text): the whole text up to 1,500 characters, else windows of 800 every 600 until one reaches the end;
    blank windows are left out before numbering. Null and empty texts give an empty array."""
    n = F.length(text)
    last = F.greatest(F.ceil((n - OVERLAP) / F.lit(float(STEP))) - 1, F.lit(0)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.substr(text, i * STEP + 1, F.lit(SIZE)))
    parts = F.when(n.isNull() | (n == 0), F.array().cast("array<string>")).when(n <= WHOLE, F.array(text)).otherwise(F.filter(cut, lambda x: F.length(F.regexp_replace(x, r"\s+", "")) > 0))
    return F.transform(parts, lambda x, i: F.struct(i.alias("idx"), x.alias("text")))


def char_chunks(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.explode(windows(F.col(text))).alias("c")).select(*keep, F.col("c.idx").alias("chunk_idx"), F.col("c.text").alias("text"))


def _plain(text: str) -> list[str]:
    if len(text) <= WHOLE:
        return [text] if text else []
    ends = range(0, max(1, -(-(len(text) - OVERLAP) // STEP)))
    return [w for w in (text[k * STEP : k * STEP + SIZE] for k in ends) if w.strip()]


def by_speaker(text: str, keep_head: bool = False) -> list[str]:
    """Stretches from marker to marker, joined while they stay within 1.5 windows; those over two windows are cut into
    windows. What stands before the first marker is dropped unless `keep_head`. Without markers: plain windows."""
    at = [m.start() for m in _MARK.finditer(text)]
    if not at:
        return _plain(text)
    if keep_head and at[0] > 0:
        at = [0, *at]
    out: list[str] = []
    held = ""
    for a, b in zip(at, [*at[1:], len(text)]):
        part = text[a:b]
        if len(held) + len(part) <= 1.5 * SIZE:
            held += part
            continue
        out += [held] if held else []
        held = part
        if len(part) > 2 * SIZE:
            out += _plain(part)
            held = ""
    return out + ([held] if held else [])


def speaker_chunks(df: DataFrame, text: str, keep: list[str], keep_head: bool = False) -> DataFrame:
    """An order-dependent fold over each text; the rows of a text come out of one batch."""
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for pdf in batches:
            rows = [(*k, i, c) for *k, t in pdf[[*keep, text]].itertuples(index=False) if t for i, c in enumerate(by_speaker(t, keep_head))]
            yield pd.DataFrame(rows, columns=[*keep, "chunk_idx", "text"])

    return df.where(F.col(text).isNotNull()).select(*keep, text).mapInPandas(run, f"{fields}, chunk_idx int, text string")


def _id(*parts) -> Column:
    seed = F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts], F.substring("text", 1, 80))
    return digest16(seed)


def bill_chunks(bill_text: DataFrame) -> DataFrame:
    """Chunks of the reasons and of the whole text, each under its own sub-source."""
    both = bill_text.select("bill_id", F.explode(F.array(F.struct(F.lit("reason").alias("sub"), F.col("reason_and_content").alias("body")), F.struct(F.lit("full").alias("sub"), F.col("full_text").alias("body")))).alias("x")).select("bill_id", "x.sub", "x.body")
    c = char_chunks(both, "body", ["bill_id", "sub"])
    return c.select(_id("bill:", F.col("bill_id"), ":", F.col("sub"), ":", F.col("chunk_idx"), ":").alias("chunk_id"), F.lit("bill").alias("source"), F.col("sub").alias("sub_source"), F.col("bill_id").alias("ref_id"), "chunk_idx", "text")


def bill_cards(bills: DataFrame) -> DataFrame:
    v = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    lines = [
        F.concat(F.lit("법안명: "), v("bill_name")), F.when(F.col("age").isNotNull() & (F.col("age") != 0), F.concat(F.lit(""), v("age"), F.lit("대"))),
        F.concat(F.lit("발의자: "), F.coalesce(F.nullif("proposer", F.lit("")), v("lead_proposer"))), F.concat(F.lit("위원회: "), v("committee")),
        F.concat(F.lit("제안일: "), v("propose_date")), F.concat(F.lit("처리결과: "), v("proc_result")),
    ]
    lines[1] = F.when(lines[1].isNotNull(), F.concat(F.lit("대수: "), lines[1]))
    t = bills.select("bill_id", F.concat_ws("\n", *lines).alias("text"))
    return t.select(_id("bill_meta:", F.col("bill_id"), ":").alias("chunk_id"), F.lit("bill_meta").alias("source"), F.lit(None).cast("string").alias("sub_source"), F.col("bill_id").alias("ref_id"), F.lit(0).alias("chunk_idx"), "text")


def member_cards(members: DataFrame) -> DataFrame:
    """One card per member; empty fields are left out."""
    fields = {"이름": "name", "정당": "party", "지역구": "district", "위원회": "committee", "당선횟수": "reelect", "역대대수": "terms_list", "성별": "gender"}
    lines = [F.when(F.col(c) != "", F.concat(F.lit(f"{k}: "), F.col(c))) for k, c in fields.items()]
    t = members.select("mona_cd", F.concat_ws("\n", *lines).alias("text")).where("text <> ''")
    return t.select(_id("member:", F.col("mona_cd"), ":").alias("chunk_id"), F.lit("member").alias("source"), F.lit(None).cast("string").alias("sub_source"), F.col("mona_cd").alias("ref_id"), F.lit(0).alias("chunk_idx"), "text")


def document_chunks(documents: DataFrame) -> DataFrame:
    """Transcripts by speaker, other documents by windows; only texts over 50 characters."""
    d = documents.where(F.length("full_text") > 50).select("doc_id", "source", "full_text")
    talk = F.col("source").startswith("minutes_")
    c = speaker_chunks(d.where(talk), "full_text", ["doc_id", "source"]).unionByName(char_chunks(d.where(~talk), "full_text", ["doc_id", "source"]))
    return c.select(_id("doc:", F.col("doc_id"), ":", F.col("source"), ":", F.col("chunk_idx"), ":").alias("chunk_id"), F.lit("document").alias("source"), F.col("source").alias("sub_source"), F.col("doc_id").alias("ref_id"), "chunk_idx", "text")


def speech_chunks(speeches: DataFrame) -> DataFrame:
    """Speeches (conf_id, speech_idx, text) of more than 5 characters."""
    c = char_chunks(speeches.where(F.length("text") > 5).select("conf_id", "speech_idx", "text"), "text", ["conf_id", "speech_idx"])
    return c.select(_id("sp:", F.col("conf_id"), ":", F.col("speech_idx"), ":", F.col("chunk_idx"), ":").alias("chunk_id"), F.lit("speech").alias("source"), F.lit(None).cast("string").alias("sub_source"), F.col("conf_id").alias("ref_id"), "chunk_idx", "text")


def not_indexed(chunks: DataFrame, registered: DataFrame, version: str) -> DataFrame:
    """Chunks that the registry doesn't hold for this embedding version, one row per id."""
    done = registered.where(F.col("embed_config_ver") == version).select("chunk_id")
    return chunks.join(done, "chunk_id", "left_anti").groupBy("chunk_id").agg(F.min("text").alias("text"))
