"""From raw articles to a clean, dated, deduplicated table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates, text
from ..session import materialize, spread
from ..sources.tables import stopword_table

CLEANED = ["title", "text", "summary", "keywords", "topics", "dialect", "author"]
SOURCES = ["url", "text", "htmldate", "missing"]


#: The columns of the clean table in its order.
CANONICAL_COLUMNS = ("title", "text", "summary", "keywords", "topics", "dialect", "url", "author", "document", "short_document", "document_nostop", "timestamp", "timestamp_source", "timestamp_quality")


def canonical(df: DataFrame, names: Sequence[str] = CANONICAL_COLUMNS) -> DataFrame:
    """The named columns in their order, absent ones as empty text."""
    return df.select(*[F.col(n) if n in df.columns else F.lit("").alias(n) for n in names])


def corpus_stopwords(df: DataFrame, column: str, share: float = 0.1, cleaned: bool = False) -> list[str]:
    """The stopwords of a corpus: those of the file the setting `spark.newsgrain.stopwords` names, else the tokens that stand in `share` of all rows or more.

    By the rule there are at most 1 / share times as many as a row has different tokens on average.
    """
    path = df.sparkSession.conf.get("spark.newsgrain.stopwords", "")
    if path:
        found = stopword_table(df.sparkSession, path)
    else:
        rows = df.count()
        plain = F.col("t") if cleaned else text.clean_text(F.col("t"))
        seen = spread(df.select(F.col(column).alias("t"))).select(F.explode(F.array_distinct(text.tokens(plain))).alias("word"))
        found = seen.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(share) * rows)
    return sorted(r["word"] for r in found.select("word").collect())


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def clean_columns(df: DataFrame) -> DataFrame:
    """The text columns cleaned; absent ones as empty text."""
    return df.withColumns({c: text.clean_text(F.col(c) if c in df.columns else F.lit(None).cast("string")) for c in CLEANED})


def build_documents(df: DataFrame, stopwords: Sequence[str] = (), cleaned: bool = False) -> DataFrame:
    """document, short_document (first 500 characters of the text) and document_nostop (document without `stopwords`) from title and text.

    cleaned: title and text are clean already, so that their joined form only has to be trimmed.
    """
    title, body = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    if cleaned:
        whole = df.withColumns({"document": F.trim(F.concat(title, F.lit(". "), body)), "short_document": F.trim(F.concat(title, F.lit(". "), F.substring(body, 1, 500)))})
        return whole.withColumn("document_nostop", text.remove_stopwords(F.col("document"), list(stopwords)))
    return df.withColumns({
        "document": text.clean_text(F.concat(title, F.lit(". "), body)),
        "short_document": text.clean_text(F.concat(title, F.lit(". "), F.substring(body, 1, 500))),
        "document_nostop": text.document_nostop(F.concat(title, F.lit(". "), body), list(stopwords)),
    })


def attach_dates(df: DataFrame, as_of: str, page_dates: DataFrame | None = None) -> DataFrame:
    """timestamp, timestamp_source and timestamp_quality: from the link, else the text, else stored page dates (url, page_date)."""
    if page_dates is not None:
        df = df.join(page_dates, "url", "left")
    else:
        df = df.withColumn("page_date", F.lit(None).cast("date"))
    u, t = dates.url_date(F.col("url"), as_of), dates.text_date(F.col("text"), as_of)
    dated = df.withColumn("__u", u).withColumn("__t", t)
    source = F.when(F.col("__u").isNotNull(), "url").when(F.col("__t").isNotNull(), "text").when(F.col("page_date").isNotNull(), "htmldate").otherwise("missing")
    dated = dated.withColumn("__s", source).withColumn("__d", F.coalesce("__u", "__t", "page_date"))
    dated = dated.withColumn("timestamp_quality", dates.timestamp_quality(F.col("__d"), F.col("__s"), as_of))
    rejected = F.col("timestamp_quality") == "rejected_future"
    dated = dated.withColumn("timestamp", F.when(~rejected, F.col("__d"))).withColumn("timestamp_source", F.when(rejected, "missing").otherwise(F.col("__s")))
    return dated.drop("__u", "__t", "__s", "__d", "page_date")


def keep_first_documents(df: DataFrame, order: str = "row_idx") -> DataFrame:
    """Rows with title and document, the first one of every document by `order`. Documents are told apart by a hash of 128 bits."""
    full = df.where((F.trim("title") != "") & (F.trim("document") != ""))
    w = Window.partitionBy(F.md5("document")).orderBy(order)
    return full.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def curate(raw: DataFrame, as_of: str, stopwords: Sequence[str] | None = None, page_dates: DataFrame | None = None) -> DataFrame:
    """The whole of curation: cleaned, dated, with documents, one row a document.

    stopwords: those of the raw texts by rule unless given (see corpus_stopwords); page_dates: dates of stored pages by link.
    """
    # written once, so that no later step cleans a text again
    cleaned = materialize(clean_columns(spread(raw)), "cleaned")
    if stopwords is None:
        stopwords = corpus_stopwords(cleaned.select(F.concat("title", F.lit(". "), "text").alias("whole")), "whole", cleaned=True)
    return keep_first_documents(build_documents(attach_dates(cleaned, as_of, page_dates), stopwords, cleaned=True))


def domain_coverage(df: DataFrame) -> DataFrame:
    """Per site: rows, rows by date source, coverage in percent."""
    by = [F.count_if(F.col("timestamp_source") == s).alias(f"n_{s}") for s in SOURCES]
    agg = df.groupBy("domain").agg(F.count("*").alias("n_rows"), *by)
    return agg.withColumn("coverage_pct", 100 * (F.col("n_rows") - F.col("n_missing")) / F.col("n_rows"))
