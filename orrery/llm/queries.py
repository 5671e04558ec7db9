"""Registered queries of the subpackage."""

from pyspark.sql import functions as F

from orrery.llm import p1_turns, p2_furniture, p3_scans, p4_neighbours, p5_copies, p7_split, p8_leaks, p9_mix, p10_encoding
from orrery.session import table


def p1_found(spark, d):
    return p1_turns.turns(p1_turns.minutes(table(spark, d, "document_text"))).select("doc_id", "source", "turn_no", "speaker")


def p1_turns_clean(spark, d):
    return p1_turns.turns(p1_turns.minutes(table(spark, d, "document_text"), table(spark, d, "chunks")))


def p2_found(spark, d):
    return p2_furniture.found(table(spark, d, "news_articles"))


def p2_clean(spark, d):
    news = table(spark, d, "news_articles")
    return p2_furniture.rebuild(news, p2_furniture.folded(news).hits())


def p5_found(spark, d):
    return p5_copies.found(table(spark, d, "news_articles"))


def p5_records(spark, d):
    return p5_copies.collapsed(table(spark, d, "news_articles"))


def _scans(spark, d):
    return p3_scans.items(table(spark, d, "bill_text"), table(spark, d, "document_text"))


def p3_found(spark, d):
    return p3_scans.disturbed(_scans(spark, d))


def p3_paragraphs(spark, d):
    return p3_scans.paragraphs(_scans(spark, d))


def p4_found(spark, d):
    return p4_neighbours.found(table(spark, d, "chunks"))


def p4_top5(spark, d):
    return p4_neighbours.neighbours(table(spark, d, "chunks"))


def _items(spark, d):
    return p7_split.items(table(spark, d, "bill_text"), table(spark, d, "document_text"), table(spark, d, "chunks"))


def p7_found(spark, d):
    return p7_split.found(_items(spark, d))


def p7_pieces(spark, d):
    return p7_split.pieces(_items(spark, d))


def p7_rebuilt(spark, d):
    return p7_split.rebuilt(_items(spark, d))


def p9_bounds(spark, d):
    return p9_mix.bounds(p9_mix_documents(spark, d), table(spark, d, "mix_targets"))


def p8_found(spark, d):
    return p8_leaks.leaks(table(spark, d, "documents"), table(spark, d, "bench_items"))


def p8_items(spark, d):
    """Documents per leaked test item."""
    return p8_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def p9_mix_documents(spark, d):
    return p9_mix.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark, d):
    return p9_mix.shares(p9_mix_documents(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark, d):
    return p10_encoding.repairs(table(spark, d, "documents"), with_text=False).select("doc_id").distinct()


def p10_restored(spark, d):
    return p10_encoding.repairs(table(spark, d, "documents"))


def queries():
    return {
        "p1_found": p1_found,
        "p1_turns": p1_turns_clean,
        "p2_found": p2_found,
        "p2_clean": p2_clean,
        "p3_found": p3_found,
        "p3_paragraphs": p3_paragraphs,
        "p4_found": p4_found,
        "p4_top5": p4_top5,
        "p5_found": p5_found,
        "p5_records": p5_records,
        "p7_found": p7_found,
        "p7_pieces": p7_pieces,
        "p7_rebuilt": p7_rebuilt,
        "p8_found": p8_found,
        "p8_items": p8_items,
        "p9_mix": p9_mix_documents,
        "p9_shares": p9_shares,
        "p9_bounds": p9_bounds,
        "p10_found": p10_found,
        "p10_restored": p10_restored,
    }


_P7_FOUND = """
SELECT DISTINCT 'bill_text' AS item_table, bill_id AS item_key FROM bill_text WHERE length(full_text) > 1500 AND bill_id IS NOT NULL
UNION SELECT 'document_text', source || ':' || doc_id FROM document_text WHERE length(full_text) > 1500 AND source IS NOT NULL AND doc_id IS NOT NULL
UNION SELECT 'chunks', chunk_id FROM chunks WHERE length(text) > 1500 AND chunk_id IS NOT NULL
"""


# Groups as reachability over shared keys, written on whole strings: the first key is the letters and digits in order,
# the second the sorted list of the labelled lines behind the others.
_P5_GROUPS = r"""
WITH RECURSIVE rows_ AS (
  SELECT DISTINCT coalesce(lower(trim(provider, E' \t\n\r')), '') AS p, news_id, content
  FROM news_articles WHERE news_id IS NOT NULL AND content IS NOT NULL),
lines_ AS (SELECT p, news_id, content, generate_subscripts(string_split(content, chr(10)), 1) AS no, unnest(string_split(content, chr(10))) AS line FROM rows_),
cut AS (SELECT *, replace(line, '：', ':') AS y FROM lines_),
told AS (SELECT p, news_id, content, no, regexp_replace(lower(line), '[^\p{L}\p{N}]', '', 'g') AS plain,
  strpos(y, ':') > 0 AND regexp_matches(left(y, strpos(y, ':') - 1), '\p{L}') AS labelled FROM cut),
doc AS (SELECT p, news_id, content, string_agg(plain, '' ORDER BY no) AS k1, count(*) FILTER (labelled) AS fields,
  coalesce(string_agg(plain, '' ORDER BY no) FILTER (NOT labelled), '') || chr(10)
    || coalesce(string_agg(plain, chr(10) ORDER BY plain) FILTER (labelled), '') AS k2 FROM told GROUP BY ALL),
keyed AS (SELECT p, news_id, k1, CASE WHEN fields < 2 THEN k1 ELSE k2 END AS k2 FROM doc WHERE k1 <> ''),
link AS (SELECT a.p, a.news_id AS x, b.news_id AS y FROM keyed a JOIN keyed b ON a.p = b.p AND a.k1 = b.k1
  UNION SELECT a.p, a.news_id, b.news_id FROM keyed a JOIN keyed b ON a.p = b.p AND a.k2 = b.k2),
reach AS (SELECT p, x, y FROM link UNION SELECT r.p, r.x, l.y FROM reach r JOIN link l ON r.p = l.p AND r.y = l.x)
"""
_P5_FOUND = _P5_GROUPS + "SELECT DISTINCT min(y) AS news_id_keep, x AS news_id_copy FROM reach GROUP BY p, x HAVING min(y) <> x"
_P5_RECORDS = _P5_GROUPS + r""", g AS (SELECT p, x, min(y) AS keep FROM reach GROUP BY 1, 2),
every AS (SELECT DISTINCT coalesce(lower(trim(provider, E' \t\n\r')), '') AS p, news_id AS x FROM news_articles WHERE news_id IS NOT NULL)
SELECT p AS provider, coalesce(keep, x) AS news_id, count(*) AS copies FROM every LEFT JOIN g USING (p, x) GROUP BY 1, 2
"""


_P7_REBUILT = """
WITH items AS (
  SELECT 'bill_text' AS item_table, bill_id AS item_key, full_text AS t FROM bill_text
  UNION SELECT 'document_text', source || ':' || doc_id, full_text FROM document_text
  UNION SELECT 'chunks', chunk_id, text FROM chunks)
SELECT item_table, item_key, md5(t) AS digest, true AS fits, true AS joined FROM items WHERE t <> '' AND item_key IS NOT NULL
"""

_P9_BOUNDS = r"""
WITH spelled AS (SELECT regexp_replace(lower(trim(source, E' \t\n\r')), '[\s_-]+', '_', 'g') AS source, target_share AS share FROM mix_targets WHERE source IS NOT NULL),
listed AS (SELECT source, sum(share) AS share FROM spelled GROUP BY source),
held AS (SELECT DISTINCT regexp_replace(lower(trim(source, E' \t\n\r')), '[\s_-]+', '_', 'g') AS source FROM documents WHERE text <> '' AND source IS NOT NULL)
SELECT source, round(share / (SELECT sum(share) FROM listed SEMI JOIN held USING (source)), 9) AS target, true AS reached, true AS repeats_ok
FROM listed SEMI JOIN held USING (source)
"""


def oracle_sql():
    return {"p5_found": _P5_FOUND, "p5_records": _P5_RECORDS, "p7_found": _P7_FOUND, "p7_rebuilt": _P7_REBUILT, "p9_bounds": _P9_BOUNDS}
