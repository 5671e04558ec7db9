"""A paged JSON service as a data source: the driver asks for the total, each partition fetches its pages."""

from __future__ import annotations

import json
import math
import time
import urllib.error
import urllib.parse
import urllib.request

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType


def _at(value, path: str):
    for k in path.split("."):
        value = value[int(k)] if isinstance(value, list) else value[k]
    return value


class _Pages(InputPartition):
    def __init__(self, first: int, last: int, size: int):
        self.first, self.last, self.size = first, last, size


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        get = lambda k, d: options.get(k.lower(), d)
        self.url, self.page, self.size_name = options["url"], get("pageParam", "page"), get("sizeParam", "size")
        self.total, self.rows = get("totalPath", "total"), get("rowsPath", "rows")
        self.sizes = [int(x) for x in get("sizes", "1000,100").split(",")]
        self.per_second, self.tries, self.pages = float(get("perSecond", "10")), int(get("tries", "4")), int(get("pagesPerTask", "20"))

    def fetch(self, page: int, size: int):
        """One page; server errors and refusals for load are tried again after waits that double."""
        url = f"{self.url}{'&' if '?' in self.url else '?'}{urllib.parse.urlencode({self.page: page, self.size_name: size})}"
        for k in range(self.tries):
            try:
                with urllib.request.urlopen(url, timeout=60) as r:
                    return json.load(r)
            except urllib.error.HTTPError as e:
                if k + 1 == self.tries or e.code < 500 and e.code != 429:
                    raise
            except urllib.error.URLError:
                if k + 1 == self.tries:
                    raise
            time.sleep(0.2 * 2**k)

    def partitions(self):
        """Page ranges of the largest page size that the service accepts."""
        for size in self.sizes:
            try:
                n = math.ceil(int(_at(self.fetch(1, size), self.total)) / size)
            except urllib.error.HTTPError:
                if size == self.sizes[-1]:
                    raise
                continue
            return [_Pages(a, min(a + self.pages - 1, n), size) for a in range(1, n + 1, self.pages)] or [_Pages(1, 0, size)]

    def read(self, partition):
        for page in range(partition.first, partition.last + 1):
            began = time.time()
            for row in _at(self.fetch(page, partition.size), self.rows):
                yield (json.dumps(row, ensure_ascii=False),)
            time.sleep(max(0.0, 1 / self.per_second - (time.time() - began)))


class PagedJson(DataSource):
    """Options: url, pageParam, sizeParam, totalPath, rowsPath, sizes (tried in order), perSecond (per task), tries,
    pagesPerTask. Rows come out as JSON text, to be landed and read with a schema."""

    @classmethod
    def name(cls):
        return "paged_json"

    def schema(self):
        return StructType([StructField("value", StringType())])

    def reader(self, schema):
        return _Reader({k.lower(): v for k, v in self.options.items()})


def paged(spark: SparkSession, url: str, **options):
    spark.dataSource.register(PagedJson)
    return spark.read.format("paged_json").options(url=url, **options).load()
