"""Labels from outside and from rules: ladders of patterns, party make-up, provider hooks with retry, versioned rounds."""

from __future__ import annotations

import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.operators.relational import insert_or_replace, todo


def highest_level(texts: Column, ladder: dict[int, list[str]], least: int = 0) -> Column:
    """The highest level of the ladder of which a pattern matches any of the texts, whatever the case; `least` where none
    does. The array is walked once, and levels are tried from the top."""

    def level(t: Column) -> Column:
        out = F.lit(least)
        for n in sorted(ladder):
            hit = None
            for p in ladder[n]:
                one = t.rlike(f"(?i){p}")
                hit = one if hit is None else hit | one
            out = F.when(hit, F.greatest(F.lit(n), F.lit(least))).otherwise(out)
        return out

    return F.aggregate(F.coalesce(texts, F.array().cast("array<string>")), F.lit(least), lambda a, t: F.greatest(a, level(t)))


def by_prefix(c: Column, prefixes: dict[str, str], other: str) -> Column:
    """The value of the first prefix the text begins with."""
    out = F.lit(other)
    for p, v in reversed(prefixes.items()):
        out = F.when(c.startswith(p), F.lit(v)).otherwise(out)
    return out


def party_shares(lead: DataFrame, others: DataFrame, key: str, party: str, unknown: str) -> DataFrame:
    """(key, total, lead_count, lead_share, parties) of the lead's (key, party) row and the others' (key, party) rows: parties
    maps each to its count, in the order of names; names without a party count as `unknown`, an unknown lead's count is 0."""
    p = F.coalesce(F.nullif(F.col(party), F.lit("")), F.lit(unknown)).alias("p")
    rows = lead.select(key, p, F.lit(True).alias("first")).unionByName(others.select(key, p, F.lit(False).alias("first")))
    n = rows.groupBy(key, "p").agg(F.count("*").alias("n"), F.max("first").alias("first"))
    out = n.groupBy(key).agg(
        F.sum("n").alias("total"),
        F.coalesce(F.sum(F.when(F.col("first") & (F.col("p") != unknown), F.col("n"))), F.lit(0)).alias("lead_count"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("p", "n")))).alias("parties"),
    )
    return out.withColumn("lead_share", F.round(F.col("lead_count") / F.col("total"), 4))


class Again(Exception):
    """A provider that wants to be asked again later raises this."""


def labelled(rows: DataFrame, key: str, text: str, provider: Callable[[str], str], tries: int = 3, wait: float = 1.0) -> DataFrame:
    """(key, label, error) of every row, asked of a provider in the tasks. `Again` is tried `tries` times in all, with waits
    that double; any other error is kept as the row's error. Null texts are errors too."""
    kind = dict(rows.dtypes)[key]

    def ask(t):
        for k in range(tries):
            try:
                return provider(t), None
            except Again as e:
                if k + 1 == tries:
                    return None, f"again: {e}"
                time.sleep(wait * 2**k)
            except Exception as e:  # noqa: BLE001
                return None, f"{type(e).__name__}: {e}"[:500]

    def run(batches):
        for pdf in batches:
            got = [(k, *(ask(t) if t is not None else (None, "no text"))) for k, t in zip(pdf[key], pdf[text])]
            yield pd.DataFrame(got, columns=[key, "label", "error"])

    return rows.select(key, text).mapInPandas(run, f"`{key}` {kind}, label string, error string")


def label_round(rows: DataFrame, done: DataFrame, key: str, text: str, version: str, provider: Callable[[str], str], **kw) -> DataFrame:
    """The label table (key, version, label, error) after a round: rows without a sound label of this version are asked, and
    their rows replace earlier ones of the version; other versions stay."""
    sound = done.where((F.col("version") == version) & F.col("error").isNull())
    asked = labelled(todo(rows.where(F.col(key).isNotNull()).dropDuplicates([key]), sound, [key]), key, text, provider, **kw)
    fresh = asked.withColumn("version", F.lit(version)).select(*done.columns)
    return insert_or_replace(done, fresh, [key, "version"], "label")
