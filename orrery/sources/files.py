"""Readers and writers of the file forms in use."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orrery.functions.text import file_to_id


def views(spark: SparkSession, root: str, names: list[str]) -> list[str]:
    """Temp views over the Parquet tables that exist; the names of those that don't."""
    missing = []
    for n in names:
        try:
            spark.read.parquet(f"{root}/{n}.parquet").createOrReplaceTempView(n)
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            missing.append(n)
    return missing


ARTICLE = T.StructType([T.StructField(c, T.StringType()) for c in "news_id title content published_at provider byline category _corrupt_record".split()])


def json_articles(spark: SparkSession, root: str) -> DataFrame:
    """One JSON object per file below root: broken files and those without an id are left out, unreadable times are null."""
    df = spark.read.schema(ARTICLE).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").option("mode", "PERMISSIVE").json(root)
    ts = F.coalesce(F.try_to_timestamp("published_at"), F.try_to_timestamp("published_at", F.lit("yyyyMMddHHmmss")))
    return df.where(F.col("_corrupt_record").isNull() & F.col("news_id").isNotNull()).withColumn("published_at", ts).drop("_corrupt_record")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("mode", "DROPMALFORMED").json(path)


def text_bills(spark: SparkSession, root: str) -> DataFrame:
    """(bill_id, text) of whole text files, ids restored from the file names."""
    return spark.read.text(root, wholetext=True, pathGlobFilter="*.txt").select(file_to_id(F.col("_metadata.file_name")).alias("bill_id"), F.col("value").alias("text"))


def parquet_parts(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    return spark.read.option("pathGlobFilter", pattern).parquet(root)


def row_range(df: DataFrame, index: str, start: int, length: int) -> DataFrame:
    """Rows of an explicit index column; row groups outside the range are skipped by their statistics."""
    return df.where(F.col(index).between(start, start + length - 1))


def document_format(content: Column) -> Column:
    """pdf, hwp, hwpx, zip, unknown, or error below 500 bytes, from the first bytes."""
    head = lambda n: F.hex(F.substring(content, 1, n))
    zipped = head(4) == "504B0304"
    return (
        F.when(F.length(content) < 500, "error").when(head(4) == "25504446", "pdf").when(head(8) == "D0CF11E0A1B11AE1", "hwp")
        .when(zipped & (F.instr(F.decode(F.substring(content, 1, 200), "ISO-8859-1"), "hwp") > 0), "hwpx").when(zipped, "zip").otherwise("unknown")
    )


def binary_documents(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length", document_format(F.col("content")).alias("format"))


# Words that begin a division of a law, and words that an amendment's target begins with.
DIVISIONS = ("CHAPTER", "TITLE", "SECTION", "ANNEX")
TARGETS = ("Article", "Recital", "Annex", "Citation", "Title", "Chapter")


def articles_of(text: Column) -> Column:
    """Array of (num, title, text) of the `Article N` blocks of a law: a line with the number, a title line, the text up to the
    next heading, cut to 5,000 characters. The text is cut before every heading line, and each block is read by lines."""
    heading = r"(?m)^(?=Article\s+\d+[^\S\n]*$|(?:" + "|".join(DIVISIONS) + r")\b)"
    blocks = F.filter(F.split(text, heading), lambda b: b.rlike(r"^Article\s+\d+[^\S\n]*\n"))

    def article(b):
        lines = F.split(b, "\n")
        rest = F.slice(lines, 2, F.size(lines))
        # Blank lines between the number and the title don't count.
        lead = F.array_position(F.transform(rest, lambda x: F.trim(x) != ""), True).cast("int")
        at = F.when(lead > 0, lead).otherwise(F.size(rest) + 1)
        body = F.array_join(F.slice(rest, at + 1, F.size(rest) + 1), "\n")
        num = F.regexp_extract(F.element_at(lines, 1), r"(\d+)", 1).cast("int")
        return F.struct(num.alias("num"), F.coalesce(F.trim(F.get(rest, at - 1)), F.lit("")).alias("title"), F.substring(F.trim(body, F.lit(" \n\r\t")), 1, 5000).alias("text"))

    return F.transform(blocks, article)


#: A target word, its number and, behind a dash, a paragraph.
_TARGET = rf"(?:{'|'.join(TARGETS)})\s*\w*(?:\s*[–-]\s*paragraph\s*\d+)?"


def amendments_of(text: Column) -> Column:
    """Array of (num, target, text): from the first mention of each `Amendment N` to the next first mention; the target comes
    from the first 500 characters, the text without its first line is cut to 3,000."""
    parts = F.regexp_extract_all(text, F.lit(r"(?s)\bAmendment\s+\d+\b.*?(?=\bAmendment\s+\d+\b|\z)"), F.lit(0))
    num = lambda b: F.regexp_extract(b, r"^Amendment\s+(\d+)", 1).cast("int")
    fresh = F.aggregate(
        parts, F.array().cast("array<struct<num:int,body:string>>"),
        lambda acc, b: F.when(F.exists(acc, lambda s: s["num"] == num(b)), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["num"].alias("num"), F.concat(F.element_at(acc, -1)["body"], b).alias("body")))))
        .otherwise(F.concat(acc, F.array(F.struct(num(b).alias("num"), b.alias("body"))))),
    )
    target = lambda b: F.coalesce(F.nullif(F.trim(F.regexp_extract(F.substring(b, 1, 500), _TARGET, 0)), F.lit("")), F.lit("unknown"))
    return F.transform(fresh, lambda s: F.struct(s["num"].alias("num"), target(s["body"]).alias("target"), F.substring(F.trim(F.regexp_replace(F.trim(s["body"]), r"^[^\n]*\n?", "")), 1, 3000).alias("text")))


def selected_articles(df: DataFrame, title: str, desk: str, url: str, order: str, keyword: str, desks: list[str], keep_empty_desk: bool = True) -> DataFrame:
    """Articles whose title has the keyword and whose desk is allowed, the first of each URL."""
    from orrery.operators.relational import keep_first

    ok = F.col(desk).isin(desks)
    if keep_empty_desk:
        ok = ok | F.col(desk).isNull() | (F.col(desk) == "")
    return keep_first(df.where(F.col(title).rlike(keyword) & ok), [url], F.col(order).asc())


def write_shards(df: DataFrame, path: str, rows: int = 200_000) -> None:
    """Parquet files of at most so many rows, zstd; the committer makes them appear at once."""
    df.write.mode("overwrite").option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(path)


def write_csv_bom(df: DataFrame, path: str, limit: int = 1_000_000) -> None:
    """A CSV file with a byte order mark, for reports: the driver streams the rows, one partition at a time."""
    import csv

    tmp = f"{path}.tmp"
    with open(tmp, "w", encoding="utf-8-sig", newline="") as f:
        w = csv.writer(f)
        w.writerow(df.columns)
        for i, r in enumerate(df.toLocalIterator()):
            if i >= limit:
                raise ValueError("too many rows for a report")
            w.writerow(["" if x is None else x for x in r])
    os.replace(tmp, path)


def write_markdown(df: DataFrame, path: str, group: str, item: str) -> None:
    """A list of items per group, groups by falling size; for reports. Spark sorts, the driver streams the sorted rows."""
    n = df.groupBy(group).agg(F.count("*").alias("_n"))
    rows = df.join(n, group).orderBy(F.desc("_n"), F.asc(group), F.asc(item)).select(group, "_n", item)
    now = object()
    with open(path, "w", encoding="utf-8") as f:
        for g, size, x in rows.toLocalIterator():
            if g != now:
                f.write(("" if now.__class__ is object else "\n") + f"## {g} ({size})\n\n")
                now = g
            f.write(f"- {x}\n")
        f.write("\n")


def json_whole(spark: SparkSession, path: str, schema=None) -> DataFrame | None:
    """Files that hold one JSON value each, or None where there are none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not spark._jvm.org.apache.hadoop.fs.FileSystem.get(p.toUri(), spark._jsc.hadoopConfiguration()).globStatus(p):
        return None
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema is not None else reader).json(path)


def parquet_rows(spark: SparkSession, path: str) -> int:
    """Rows of Parquet files by a glob. No column is read, so the counts come from the files' footers."""
    return spark.read.parquet(path).count()


def shards(df: DataFrame, folder: str, rows_per_file: int = 200_000, row_group_bytes: int = 32 << 20) -> DataFrame:
    """Write zstd shards of at most so many rows, and give (file, bytes, sha256) of each. The committer renames finished files
    into place; digests are taken by the tasks that read the files."""
    df.write.option("maxRecordsPerFile", rows_per_file).option("compression", "zstd").option("parquet.block.size", row_group_bytes).parquet(folder)
    files = df.sparkSession.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(folder)
    return files.select(F.substring_index("path", "/", -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def append_versioned(new: DataFrame, folder: str, key: str, version: str) -> None:
    """Append the rows of (key, version) pairs that the table at `folder` lacks, one per key; a manifest beside it registers
    all pairs, those already there too. Both are appended, so a run that stops can be run again."""
    spark = new.sparkSession
    have = lambda name: spark.read.parquet(f"{folder}/{name}") if _there(spark, f"{folder}/{name}") else None
    rows = new.where(F.col(key).isNotNull()).dropDuplicates([key]).withColumn("version", F.lit(version))
    data, manifest = have("rows"), have("manifest")
    fresh = rows if data is None else rows.join(data.where(F.col("version") == version).select(key), key, "left_anti").select(*rows.columns)
    fresh.write.mode("append").parquet(f"{folder}/rows")
    pairs = rows.select(key, "version")
    pairs = pairs if manifest is None else pairs.join(manifest.select(key, "version"), [key, "version"], "left_anti")
    pairs.write.mode("append").parquet(f"{folder}/manifest")


def _there(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
