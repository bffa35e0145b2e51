"""Dates of stored pages: an optional provider for rows whose link and text hold no date. Nothing is fetched."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Attributes of a page that carry its publication date, best first.
DATE_PATTERNS = (
    r'(?i)<meta[^>]+(?:article:published_time|datepublished|pubdate|dc\.date)[^>]+content="(20\d{2}-\d{2}-\d{2})',
    r'(?i)<time[^>]+datetime="(20\d{2}-\d{2}-\d{2})',
    r'(?i)"datePublished"\s*:\s*"(20\d{2}-\d{2}-\d{2})',
)


def page_dates(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, page_date) of stored pages, null where none is found; one row a link (the earliest date)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re

        patterns = [re.compile(p) for p in DATE_PATTERNS]
        for batch in batches:
            found = []
            for html in batch.column(1).to_pylist():
                hits = (p.search(html or "") for p in patterns)
                found.append(next((m.group(1) for m in hits if m), None))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], names=["url", "found"])

    dated = pages.select(F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(work, "url string, found string")
    return dated.groupBy("url").agg(F.min(F.try_to_date("found", "yyyy-MM-dd")).alias("page_date"))
