"""Table fingerprints, snapshots, diffs, run log and validators."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def row_digest(df: DataFrame) -> Column:
    """A 64-bit digest of a row that tells null from empty and doesn't mix neighbouring columns."""
    return F.xxhash64(F.to_json(F.struct(*[F.col(c) for c in df.columns]), {"ignoreNullFields": "false"}))


def fingerprint(df: DataFrame) -> DataFrame:
    """(n, xor, total): equal for any order of rows; the sum tells pairs of equal rows, which cancel in the xor. The empty
    table has 0 in all."""
    h = row_digest(df)
    return df.select(h.alias("h")).agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.col("h").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("total"))


def portable_fingerprint(df: DataFrame, cols: list[str]) -> DataFrame:
    """The same on 60 bits of md5, which other engines compute alike."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    h = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    return df.select(h.alias("h")).agg(F.count("*").alias("n"), F.bit_xor("h").alias("xor"), F.sum(F.col("h").cast("decimal(38,0)")).alias("total"))


def snapshot(tables: dict[str, DataFrame], costs: dict[str, float] | None = None, budget: float | None = None, ts: dict[str, str] | None = None) -> dict[str, dict]:
    """Per table: rows, schema digest, content fingerprint, greatest write time, seconds. A table whose last fingerprint cost
    more than the budget gets none; it is unknown then, never unchanged."""
    out = {}
    for name, df in tables.items():
        began = time.time()
        schema = [(c, t) for c, t in df.dtypes]
        content = None
        if budget is None or (costs or {}).get(name, 0.0) <= budget:
            r = fingerprint(df).first()
            content, n = f"{r['xor']}:{r['total']}:{r['n']}", r["n"]
        else:
            n = df.count()
        col = (ts or {}).get(name)
        latest = df.agg(F.max(col).cast("string")).first()[0] if col else None
        out[name] = {"rows": n, "schema": json.dumps(schema), "content": content, "latest": latest, "seconds": time.time() - began}
    return out


def diff(before: dict[str, dict], after: dict[str, dict], rebuilt: set[str] = frozenset()) -> list[tuple[str, str]]:
    """(table, change); per table the first that holds of: dropped, created, rows_added, rows_removed, schema_changed,
    content_unknown, content_changed, rewritten_identical."""
    out = []
    for t in sorted({*before, *after}):
        b, a = before.get(t), after.get(t)
        if b is None or a is None:
            out.append((t, "created" if b is None else "dropped"))
        elif a["rows"] != b["rows"]:
            out.append((t, "rows_added" if a["rows"] > b["rows"] else "rows_removed"))
        elif a["schema"] != b["schema"]:
            out.append((t, "schema_changed"))
        elif a["content"] is None or b["content"] is None:
            out.append((t, "content_unknown"))
        elif a["content"] != b["content"]:
            out.append((t, "content_changed"))
        elif t in rebuilt:
            out.append((t, "rewritten_identical"))
    return out


def touched_rows(df: DataFrame, ts: str, since: Column) -> DataFrame:
    return df.where(F.col(ts) >= since).agg(F.count("*").alias("n"))


@contextmanager
def audit_run(log: str, name: str, take):
    """Snapshot before and after, and one JSON line per run with its status, changes and drift against the last run's end.
    `take` gives a snapshot."""
    before, began, event = take(), time.time(), {"run": name, "start": time.time(), "status": "ok"}
    last = [e for e in read_log(log) if "after" in e]
    event["drift"] = diff(last[-1]["after"], before) if last else []
    try:
        yield event
    except KeyboardInterrupt:
        event["status"] = "interrupted"
        raise
    except SystemExit as e:
        event["status"] = "ok" if not e.code else f"exit:{e.code}"
        raise
    except BaseException as e:
        event |= {"status": "error", "error": repr(e)[:500]}
        raise
    finally:
        after = take()
        event |= {"changes": diff(before, after), "after": after, "seconds": time.time() - began}
        with open(log, "a", encoding="utf-8") as f:
            f.write(json.dumps(event, ensure_ascii=False) + "\n")


def read_log(log: str) -> list[dict]:
    """Events of a run log; malformed lines are skipped."""
    out = []
    if os.path.exists(log):
        for line in open(log, encoding="utf-8"):
            try:
                out.append(json.loads(line))
            except ValueError:
                continue
    return out


def log_table(spark: SparkSession, log: str) -> DataFrame:
    return spark.read.option("mode", "DROPMALFORMED").json(log)


def events(log: DataFrame, table: str | None = None, since: float | None = None) -> DataFrame:
    """(run, start, status, table, change) of the changes in a run log, of one table and from one time on."""
    c = F.explode("changes").alias("c")
    rows = log.where(F.col("changes").isNotNull()).select("run", "start", "status", c).select("run", "start", "status", F.col("c")[0].alias("table"), F.col("c")[1].alias("change"))
    rows = rows.where(F.col("table") == table) if table is not None else rows
    return rows.where(F.col("start") >= since) if since is not None else rows


def prune(log: str, keep: int) -> int:
    """Keep the last `keep` runs of a log and drop malformed lines; how many lines went is given back."""
    lines = open(log, encoding="utf-8").read().splitlines() if os.path.exists(log) else []
    sound = [json.dumps(e, ensure_ascii=False) for e in read_log(log)][-keep:] if keep else []
    tmp = f"{log}.new"
    with open(tmp, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in sound)
    os.replace(tmp, log)
    return len(lines) - len(sound)


def kept_versions(df: DataFrame, keys: list[str], when: str, keep: int) -> DataFrame:
    """The `keep` latest rows of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(when).desc_nulls_last(), *[F.col(c) for c in sorted(set(df.columns) - {*keys, when})])
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= keep).drop("_rn")


def storage_fingerprint(spark: SparkSession, path: str) -> DataFrame:
    """(files, bytes, digest) of the files of a table: the digest of path, size and time of each, in the order of paths. Only
    file metadata is read; the list has a row per file."""
    m = F.col("_metadata")
    f = spark.read.parquet(path).select(m["file_path"].alias("p"), m["file_size"].alias("s"), m["file_modification_time"].cast("string").alias("t")).distinct()
    return f.agg(F.count("*").alias("files"), F.sum("s").alias("bytes"), F.md5(F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", "p", "s", "t"))), "\n")).alias("digest"))


def cast_report(df: DataFrame, column: str, to: str) -> DataFrame:
    """(value, before, after): the histogram of a column's values before and after the cast, for the values that cast and,
    under null, for those that don't; the cast is safe where both are equal for every value."""
    rows = df.select(F.col(column).alias("old"), F.col(column).try_cast(to).cast("string").alias("value"))
    return rows.groupBy("value").agg(F.count("*").alias("after"), F.count_if(F.col("old").isNotNull()).alias("before")).select("value", "before", "after")


def cast_column(df: DataFrame, column: str, to: str) -> DataFrame:
    """The table with the column cast; raises if a value doesn't cast."""
    bad = uncastable(df, column, to).limit(5).collect()
    if bad:
        raise ValueError(f"{column} has values that are no {to}: {[r['value'] for r in bad]}")
    return df.withColumn(column, F.col(column).cast(to))


def violations(tables: dict[str, DataFrame], whole: dict[str, str], no_nulls: dict[str, list[str]], not_numeric: dict[str, list[str]]) -> DataFrame:
    """(table, rule, n) of the rules that rows break: columns that must be whole numbers, columns without nulls, and labels
    that must not be bare numbers. One pass per table."""
    out = None
    for name, df in tables.items():
        checks = {f"{whole[name]} is no whole number": F.col(whole[name]).isNotNull() & F.col(whole[name]).cast("string").try_cast("int").isNull()} if name in whole else {}
        checks |= {f"{c} is null": F.col(c).isNull() for c in no_nulls.get(name, [])}
        checks |= {f"{c} is a bare number": F.col(c).cast("string").rlike(r"^\s*\d+\s*$") for c in not_numeric.get(name, [])}
        if not checks:
            continue
        n = df.agg(*[F.count_if(c).alias(str(i)) for i, c in enumerate(checks.values())])
        rows = n.select(F.explode(F.array(*[F.struct(F.lit(name).alias("table"), F.lit(rule).alias("rule"), F.col(str(i)).alias("n")) for i, rule in enumerate(checks)])).alias("x")).select("x.*")
        out = rows if out is None else out.unionByName(rows)
    return out.where("n > 0")


def uncastable(df: DataFrame, column: str, to: str) -> DataFrame:
    """(value, n) of values that don't cast."""
    return df.where(F.col(column).isNotNull() & F.col(column).try_cast(to).isNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def validate(tables: dict[str, DataFrame], required: list[str], age_tables: list[str], current_only: list[str] = ()) -> list[str]:
    """Violations: missing tables, and of the age column: missing, no integer, nulls, several values where only the current
    term may be."""
    bad = [f"{t}: missing" for t in required if t not in tables]
    for t in age_tables:
        df = tables.get(t)
        if df is None:
            continue
        kind = dict(df.dtypes).get("age")
        if kind is None:
            bad.append(f"{t}: no age")
            continue
        if kind != "int":
            bad.append(f"{t}: age is {kind}")
        nulls, distinct = df.agg(F.count_if(F.col("age").isNull()), F.count_distinct("age")).first()
        if nulls:
            bad.append(f"{t}: {nulls} null ages")
        if t in current_only and distinct != 1:
            bad.append(f"{t}: {distinct} ages")
    return bad


def ingest_report(chunks: DataFrame, embeddings: DataFrame, dim: int) -> DataFrame:
    """One row: duplicate ids, chunks without vector, vectors without chunk, wrong dimensions, non-finite vectors, and the
    least, mean and greatest norm of the sound ones."""
    v = F.col("vector")
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    e = embeddings.agg(
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("duplicates"), F.count_if(v.isNotNull() & (F.size(v) != dim)).alias("wrong_dim"),
        F.count_if(v.isNotNull() & (F.size(v) == dim) & ~fine).alias("not_finite"),
        F.min(F.when(fine, norm)).alias("norm_min"), F.avg(F.when(fine, norm)).alias("norm_mean"), F.max(F.when(fine, norm)).alias("norm_max"),
    )
    missing = chunks.select("chunk_id").join(embeddings.where(v.isNotNull()), "chunk_id", "left_anti").agg(F.count("*").alias("missing"))
    orphans = embeddings.join(chunks, "chunk_id", "left_anti").agg(F.count("*").alias("orphans"))
    return e.crossJoin(missing).crossJoin(orphans)
