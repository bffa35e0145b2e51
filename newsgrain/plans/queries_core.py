"""Queries: scans, scalar functions, curation, temporal profiles and scores, each with its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, text, topics, urls
from ..operators import curation, temporal
from ..session import shared_dir, spread
from ..sources.tables import index_reuse, index_state, table, validated, write
from .common import register, stats

AS_OF = "2024-06-30"
QUERIES, ORACLE, query = register()


def articles(spark: SparkSession, d: str) -> DataFrame:
    """clustered_data in the names the temporal operators use."""
    return table(spark, d, "clustered_data").select("row_idx", "cluster", F.col("published_at").cast("timestamp").alias("ts"), F.coalesce("source_domain", F.lit("unknown_domain")).alias("domain"), "timestamp_source", "topic_group", "title")


ARTICLES = "articles AS (SELECT row_idx, cluster, published_at AS ts, coalesce(source_domain, 'unknown_domain') AS domain, timestamp_source, topic_group, title FROM clustered_data)"
DUCK_CLEAN = "trim(regexp_replace(regexp_replace(lower(coalesce({0}, '')), '\\p{{So}}', '', 'g'), '[\\s\\v\\x{{85}}\\p{{Z}}]+', ' ', 'g'))"
DUCK_STRIP = "strip_accents({0})"


_CANON = ", ".join(f"'{t}'" for t in topics.CANONICAL)
_ALIAS = ", ".join(f"('{a}')" for a in topics.ALIAS_OF)
_KEY = "trim(regexp_replace(regexp_replace(trim(lower(strip_accents(topics))), '[-_./:]+', ' ', 'g'), '\\s+', ' ', 'g'))"
TOPIC_REASON = f"""
    WITH a AS (SELECT * FROM (VALUES {_ALIAS}) v(alias)), k AS (SELECT *, {_KEY} AS k FROM clustered_data)
    SELECT *, CASE WHEN topics IS NULL OR k IN ('', '-', 'na', 'n a', 'none', 'null', 'nan', 'unknown', 'necunoscut') THEN 'missing_topic' WHEN k = 'root' THEN 'metadata_topic' WHEN k IN ({_CANON}) THEN 'canonical_topic'
        WHEN k IN (SELECT alias FROM a) OR replace(k, ' ', '') IN (SELECT alias FROM a) OR replace(k, ' ', '') IN ({_CANON}) THEN 'mapped_topic_alias' WHEN topic_group IN ({_CANON}) THEN 'composite_topic' ELSE 'unmapped_topic' END AS reason FROM k"""


def clean(c: str) -> str:
    return DUCK_CLEAN.format(c)


# --- scans -----------------------------------------------------------------------------------------------------------


@query("S1_scan_sweep", "SELECT topic_group, topic_size, min_cluster_size, min_samples, num_clusters, selection_score FROM sweep_results")
def _(spark, d):
    return table(spark, d, "sweep_results").select("topic_group", "topic_size", "min_cluster_size", "min_samples", "num_clusters", "selection_score")


@query("S2_projected_head", "SELECT row_idx, title FROM clustered_data ORDER BY row_idx LIMIT 100")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", "title").orderBy("row_idx").limit(100)


@query("S3_validated_load", "SELECT row_idx, coalesce(title, '') AS title, coalesce(topics, '') AS topics, coalesce(url, '') AS url FROM raw_articles")
def _(spark, d):
    return validated(table(spark, d, "raw_articles"), ["title", "topics", "url"]).select("row_idx", "title", "topics", "url")


@query("S6_cluster_pushdown", "SELECT row_idx, topic_group, topic_row_idx, title FROM clustered_data WHERE cluster = 1")
def _(spark, d):
    return table(spark, d, "clustered_data").where("cluster = 1").select("row_idx", "topic_group", "topic_row_idx", "title")


@query("S12_frequent_words", """
    WITH w AS (SELECT DISTINCT row_idx, unnest(string_split(trim(regexp_replace(lower(strip_accents(coalesce(document, ''))), '[^a-z]+', ' ', 'g')), ' ')) AS word FROM clustered_data),
         n AS (SELECT count(*) AS n FROM clustered_data)
    SELECT word, count(*) AS n_docs FROM w, n WHERE word <> '' GROUP BY word, n.n HAVING count(*) * 10 >= n.n""")
def _(spark, d):
    """A stopword list by rule: the words of a tenth of all documents or more."""
    return frequent_words(table(spark, d, "clustered_data"), "document")


def frequent_words(df: DataFrame, column: str) -> DataFrame:
    """(word, n_docs): the words that stand in a tenth of all rows or more."""
    plain = F.trim(F.regexp_replace(F.lower(text.strip_diacritics(F.coalesce(column, F.lit("")))), "[^a-z]+", " "))
    words = df.select(F.explode(F.array_distinct(F.split(plain, " "))).alias("word")).where("word <> ''").groupBy("word").agg(F.count("*").alias("n_docs"))
    return words.where(F.col("n_docs") * 10 >= df.count())


@query("S17_index_reuse", """
    SELECT topic_group, count(*) AS n, topic_group <> 'sport' AS reuse FROM clustered_data GROUP BY topic_group""")
def _(spark, d):
    """An index state is stored, a text of one topic changes, and every other topic's index is still good."""
    df = table(spark, d, "clustered_data").select("topic_group", "topic_row_idx", "short_document")
    path = f"{shared_dir(spark)}/newsgrain/index-{uuid.uuid4().hex}"
    write(index_state(df, "topic_group", "topic_row_idx", "short_document", 64), path)
    changed = df.withColumn("short_document", F.when((F.col("topic_group") == "sport") & (F.col("topic_row_idx") == 0), "altfel").otherwise(F.col("short_document")))
    return index_reuse(spark.read.parquet(path), index_state(changed, "topic_group", "topic_row_idx", "short_document", 64), "topic_group")


@query("S20_topics_attached", f"""
    SELECT topic_group, reason AS topic_group_reason, count(*) AS n FROM ({TOPIC_REASON}) WHERE document IS NOT NULL AND trim(document) <> '' GROUP BY ALL""")
def _(spark, d):
    """The four columns of the clustering input with the topic and its reason worked out anew."""
    df = validated(table(spark, d, "clustered_data"), ["title", "topics", "short_document", "document"]).where(F.trim("document") != "")
    label = F.col("topics")
    return df.groupBy(topics.normalize_topic(label).alias("topic_group"), topics.topic_reason(label).alias("topic_group_reason")).agg(F.count("*").alias("n"))


# --- text functions ---------------------------------------------------------------------------------------------------


@query("X1_clean_text", f"SELECT row_idx, {clean('title')} AS cleaned FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.clean_text(F.col("title")).alias("cleaned"))


@query("X2_strip_diacritics", "SELECT row_idx, strip_accents(title) AS bare FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.strip_diacritics(F.col("title")).alias("bare"))


@query("X2_strip_diacritics_exact")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.strip_diacritics_exact(F.col("title")).alias("bare"))


@query("X3_deep_clean", """
    SELECT row_idx, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
        lower(coalesce(summary, '')), '\\p{So}', '', 'g'), '<[^>]+>', ' ', 'g'), '&[\\p{L}\\p{M}\\p{N}\\p{Pc}]+;', ' ', 'g'), 'https?://[^\\s\\v\\x{85}\\p{Z}]+', ' ', 'g'),
        '[^\\p{L}\\p{M}\\p{Nd}\\p{Nl}\\p{Pc}\\x{200c}\\x{200d}\\s\\v\\x{85}\\p{Z}''-]', ' ', 'g'), '[\\s\\v\\x{85}\\p{Z}]+', ' ', 'g')) AS cleaned FROM raw_articles""")
def _(spark, d):
    return table(spark, d, "raw_articles").select("row_idx", text.deep_clean(F.col("summary")).alias("cleaned"))


#: Documents without stopwords by rule: the tokens of a tenth of all documents or more.
NOSTOP_SQL = """
    SELECT a.row_idx, a.topic_group, a.cluster, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (w NOT IN (SELECT w FROM stop)), '') AS kept
    FROM clustered_data a LEFT JOIN tokens t ON a.row_idx = t.row_idx GROUP BY ALL"""
NOSTOP_WITH = """
    tokens AS (SELECT row_idx, i, w FROM (SELECT row_idx, i, trim(strip_accents(w), '.,;:!?"''()…»«/\\') AS w FROM (
            SELECT row_idx, unnest(string_split(p, ' ')) AS w, generate_subscripts(string_split(p, ' '), 1) AS i FROM (
                SELECT row_idx, trim(regexp_replace({clean}, '[\\s\\v\\x{{85}}\\p{{Z}}–—-]+', ' ', 'g')) AS p FROM clustered_data))) WHERE length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+')),
    stop AS (SELECT w FROM tokens GROUP BY w HAVING count(DISTINCT row_idx) * 10 >= (SELECT count(*) FROM clustered_data))""".format(clean=clean("document"))


@query("X4_remove_stopwords", f"WITH {NOSTOP_WITH} SELECT row_idx, kept FROM ({NOSTOP_SQL})")
def _(spark, d):
    """Whole documents, cleaned, without the stopwords of the corpus."""
    df = spread(table(spark, d, "clustered_data").select("row_idx", "document"))
    return df.select("row_idx", text.document_nostop(F.col("document"), curation.corpus_stopwords(df, "document")).alias("kept"))


DUCK_NORMAL = "trim(regexp_replace(lower(strip_accents(coalesce({0}, ''))), '[^a-z0-9]+', ' ', 'g'))"


@query("X5_normalize_text", f"SELECT row_idx, {DUCK_NORMAL.format('title')} AS normal FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.normalize_text(F.col("title")).alias("normal"))


@query("X6_contains_any", f"SELECT row_idx, regexp_matches(' ' || {DUCK_NORMAL.format('title')} || ' ', ' (votul|buget|in lume|alegeri|protest) ') AS hit FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.contains_any(text.normalize_text(F.col("title")), ("votul", "buget", "in lume", "alegeri", "protest")).alias("hit"))


@query("X7_routine_health", f"""
    SELECT row_idx, regexp_matches(n, 'covid|coronavirus|vaccin|carantin|pcr') AND regexp_matches(' ' || n || ' ', ' ({"|".join(text.ROUTINE_HEALTH_TERMS)}) ') AS routine
    FROM (SELECT row_idx, {DUCK_NORMAL.format('short_document')} AS n FROM clustered_data)""")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.routine_health(text.normalize_text(F.col("short_document"))).alias("routine"))


@query("X10_safe_name", "SELECT DISTINCT topics, trim(regexp_replace(topics, '[^A-Za-z0-9._-]+', '_', 'g'), '_') AS name FROM clustered_data WHERE topics IS NOT NULL")
def _(spark, d):
    return table(spark, d, "clustered_data").where("topics is not null").select("topics").distinct().withColumn("name", text.safe_name(F.col("topics")))


@query("X11_shorten", "SELECT row_idx, CASE WHEN length(title) > 60 THEN rtrim(substr(title, 1, 59)) || '…' ELSE title END AS short FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.shorten(F.col("title"), 60).alias("short"))


@query("X12_labels", """
    SELECT DISTINCT timestamp_source, CASE timestamp_source WHEN 'url' THEN 'Link' WHEN 'text' THEN 'Text' WHEN 'htmldate' THEN 'Page'
        ELSE upper(substr(timestamp_source, 1, 1)) || substr(timestamp_source, 2) END AS shown FROM clustered_data""")
def _(spark, d):
    return table(spark, d, "clustered_data").select("timestamp_source").distinct().withColumn("shown", text.label(F.col("timestamp_source"), {"url": "Link", "text": "Text", "htmldate": "Page"}))


@query("X13_fix_link", "SELECT row_idx, CASE WHEN trim(url) = '' THEN '' WHEN regexp_matches(url, '^https?://') THEN url ELSE 'https://' || url END AS link FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", text.fix_link(F.col("url")).alias("link"))


@query("X14_fingerprint", "SELECT topic_group, topic_row_idx // 1000 AS block, sha256(string_agg(coalesce(title, ''), chr(0) ORDER BY topic_row_idx)) AS fingerprint FROM clustered_data GROUP BY ALL")
def _(spark, d):
    """Fingerprints of blocks of a thousand texts."""
    df = table(spark, d, "clustered_data")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("topic_row_idx", F.coalesce("title", F.lit("")).alias("t")))), lambda e: e["t"])
    return df.groupBy("topic_group", F.floor(F.col("topic_row_idx") / 1000).alias("block")).agg(text.fingerprint(texts).alias("fingerprint"))


# --- topics -----------------------------------------------------------------------------------------------------------


@query("G5_normalize_topic", """
    SELECT row_idx, topic_group FROM clustered_data""")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", topics.normalize_topic(F.col("topics")).alias("topic_group"))


@query("G6_topic_reason", f"SELECT row_idx, reason FROM ({TOPIC_REASON})")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", topics.topic_reason(F.col("topics")).alias("reason"))


@query("G2_topic_key", "SELECT DISTINCT topics, trim(regexp_replace(regexp_replace(trim(lower(strip_accents(topics))), '[-_./:]+', ' ', 'g'), '\\s+', ' ', 'g')) AS topic_key FROM clustered_data WHERE topics IS NOT NULL")
def _(spark, d):
    return table(spark, d, "clustered_data").where("topics is not null").select("topics").distinct().withColumn("topic_key", topics.topic_key(F.col("topics")))


@query("G7_distinct_then_join", "SELECT topic_group, count(*) AS n FROM clustered_data GROUP BY topic_group")
def _(spark, d):
    """Topics evaluated once per distinct label and joined back."""
    df = table(spark, d, "clustered_data").select("topics")
    names = df.distinct().withColumn("topic_group", topics.normalize_topic(F.col("topics"))).withColumnRenamed("topics", "t")
    return df.join(names, F.col("topics").eqNullSafe(F.col("t"))).groupBy("topic_group").agg(F.count("*").alias("n"))


# --- links ------------------------------------------------------------------------------------------------------------

DUCK_HOST = "regexp_extract(lower({0}), '^[a-z][a-z0-9+.\\-]*://([^/?#]*)', 1)"


@query("L1_report_domain", f"""
    SELECT row_idx, CASE WHEN u = '' OR h = '' THEN 'missing' ELSE h END AS domain FROM (
        SELECT row_idx, u, regexp_replace({DUCK_HOST.format("CASE WHEN contains(u, '://') THEN u ELSE 'http://' || u END")}, '^www\\.', '') AS h FROM (SELECT row_idx, trim(coalesce(url, '')) AS u FROM clustered_data))""")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", urls.report_domain(F.col("url")).alias("domain"))


@query("L2_temporal_domain", f"""
    SELECT row_idx, CASE WHEN h = '' THEN 'unknown_domain' ELSE h END AS domain FROM (
        SELECT row_idx, regexp_replace(regexp_replace(regexp_replace({DUCK_HOST.format("trim(coalesce(url, ''))")}, '^.*@', ''), ':.*$', ''), '^www\\.', '') AS h FROM clustered_data)""")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", urls.temporal_domain(F.col("url")).alias("domain"))


@query("L3_serving_domain", f"""
    SELECT row_idx, CASE WHEN u = '' THEN '' ELSE regexp_replace({DUCK_HOST.format("CASE WHEN contains(u, '://') THEN u ELSE 'https://' || u END")}, '^www\\.', '') END AS domain
    FROM (SELECT row_idx, trim(coalesce(url, '')) AS u FROM clustered_data)""")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", urls.serving_domain(F.col("url")).alias("domain"))


@query("L4_unquote", "SELECT row_idx, url_decode(replace(url, '+', '%2B')) AS plain FROM clustered_data")
def _(spark, d):
    return table(spark, d, "clustered_data").select("row_idx", urls.unquote(F.col("url")).alias("plain"))


@query("L5_query_parameters", """
    WITH q AS (SELECT row_idx, list_filter(string_split(regexp_extract(url || CASE WHEN row_idx % 2 = 0 THEN CASE WHEN contains(url, '?') THEN '&' ELSE '?' END || 'Page=' || row_idx || '&page=&x=1%202&x=' || row_idx ELSE '' END, '\\?([^#]*)', 1), '&'), lambda p: p <> '') AS p FROM clustered_data WHERE url IS NOT NULL AND NOT contains(url, '#')),
        e AS (SELECT row_idx, i, lower(split_part(x, '=', 1)) AS k, regexp_replace(x, '^[^=]*=?', '') AS v FROM (SELECT row_idx, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM q))
    SELECT row_idx, k AS name, arg_max(v, i) AS value FROM e GROUP BY row_idx, k""")
def _(spark, d):
    """Parameters of links by lower-case name, the last value of a repeated one; every second link gets some."""
    u, odd = F.col("url"), F.col("row_idx") % 2 == 0
    more = F.when(odd, F.concat(F.when(F.contains(u, F.lit("?")), "&").otherwise("?"), F.lit("Page="), F.col("row_idx").cast("string"), F.lit("&page=&x=1%202&x="), F.col("row_idx").cast("string"))).otherwise("")
    df = table(spark, d, "clustered_data").where("url is not null and not contains(url, '#')")
    found = urls.query_map(F.regexp_extract(F.concat(u, more), r"\?([^#]*)", 1))
    return df.select("row_idx", F.explode(found).alias("name", "value"))


# --- dates ------------------------------------------------------------------------------------------------------------


@query("D9_D10_D11_buckets", """
    SELECT row_idx, CAST(published_at AS DATE) AS day, CAST(date_trunc('week', CAST(published_at AS DATE) - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE) AS tuesday_week,
        CAST(date_trunc('week', CAST(published_at AS DATE)) + INTERVAL 6 DAY AS DATE) AS sunday_week, last_day(published_at) AS month_end FROM clustered_data""")
def _(spark, d):
    day = F.to_date("published_at")
    return table(spark, d, "clustered_data").select("row_idx", day.alias("day"), dates.tuesday_week(day).alias("tuesday_week"), dates.sunday_week(day).alias("sunday_week"), F.last_day(day).alias("month_end"))


@query("D12_month_series", """
    WITH m AS (SELECT CAST(date_trunc('month', published_at) AS DATE) AS month, count(*) AS n FROM clustered_data WHERE published_at IS NOT NULL GROUP BY 1),
         c AS (SELECT CAST(unnest(generate_series(DATE '2010-01-01', DATE '2025-12-01', INTERVAL 1 MONTH)) AS DATE) AS month)
    SELECT c.month, coalesce(m.n, 0) AS n FROM c LEFT JOIN m USING (month)""")
def _(spark, d):
    months = spark.sql("SELECT explode(sequence(DATE'2010-01-01', DATE'2025-12-01', INTERVAL 1 MONTH)) AS month")
    counts = table(spark, d, "clustered_data").where("published_at is not null").groupBy(F.to_date(F.date_trunc("month", "published_at")).alias("month")).agg(F.count("*").alias("n"))
    return months.join(counts, "month", "left").select("month", F.coalesce("n", F.lit(0)).alias("n"))


@query("D13_whole_days", "SELECT row_idx, CAST(floor((epoch_us(published_at) - epoch_us(TIMESTAMP '2019-01-01')) / 86400000000) AS BIGINT) AS days FROM clustered_data WHERE published_at IS NOT NULL")
def _(spark, d):
    df = table(spark, d, "clustered_data").where("published_at is not null")
    return df.select("row_idx", dates.whole_days(F.col("published_at").cast("timestamp"), F.lit("2019-01-01").cast("timestamp")).alias("days"))




def _duck_date(y: str, m: str, d: str) -> str:
    return f"CASE WHEN try_cast({y} AS INT) BETWEEN 2015 AND 2025 THEN try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') AS DATE) END"


def duck_candidate(c: str) -> str:
    """The date in a path or value, as dates.candidate_date; DuckDB's patterns do not look around, so a guard takes a character."""
    month, day = "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
    year_first = f"(?:^|[^0-9])(20[0-9]{{2}})[/._-]{month}[/._-]{day}(?:[^0-9]|$)"
    day_first = f"(?:^|[^0-9]){day}[/._-]{month}[/._-](20[0-9]{{2}})(?:[^0-9]|$)"
    compact = "(?:^|[^0-9])(20[0-9]{2})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])(?:[^0-9]|$)"
    g = lambda p, k: f"regexp_extract({c}, '{p}', {k})"
    return (
        f"CASE WHEN regexp_matches({c}, '{year_first}') THEN {_duck_date(g(year_first, 1), g(year_first, 2), g(year_first, 3))} WHEN regexp_matches({c}, '{day_first}') THEN {_duck_date(g(day_first, 3), g(day_first, 2), g(day_first, 1))} "
        f"WHEN regexp_matches({c}, '{compact}') THEN {_duck_date(g(compact, 1), g(compact, 2), g(compact, 3))} END"
    )


def duck_url_date(url: str) -> str:
    """The date in a link, as dates.url_date."""
    u = f"coalesce(url_decode(replace({url}, '+', '%2B')), {url})"
    rest = f"regexp_replace(CASE WHEN contains({u}, '://') THEN {u} ELSE 'http://' || {u} END, '^[^:]*://[^/?#]*', '')"
    path, query_, fragment = f"regexp_extract({rest}, '^([^?#]*)', 1)", f"regexp_extract({rest}, '\\?([^#]*)', 1)", f"regexp_extract({rest}, '#(.*)$', 1)"
    value = lambda n: f"regexp_extract({query_}, '(?:^|&){n}=([^&]*)', 1)"
    keys = ", ".join(f"'{k}'" for k in dates.QUERY_KEYS)
    entries = f"list_filter(string_split({query_}, '&'), lambda q: lower(split_part(q, '=', 1)) IN ({keys}))"
    plain = "url_decode(replace(regexp_replace(q, '^[^=]*=?', ''), '+', '%2B'))"
    known = f"list_filter(list_transform({entries}, lambda q: {duck_candidate(plain)}), lambda z: z IS NOT NULL)[1]"
    in_query = f"CASE WHEN {value('year')} <> '' AND {value('month')} <> '' AND {value('day')} <> '' THEN {_duck_date(value('year'), value('month'), value('day'))} ELSE {known} END"
    return f"coalesce({duck_candidate(path)}, {duck_candidate(fragment)}, {in_query}, {duck_candidate(u)})"


def duck_text_date(t: str) -> str:
    """The date in the head of a text, as dates.text_date."""
    head = f"substr({t}, 1, {dates.SCAN_CHARS})"
    cues = "|".join(dates.CUES)
    out = []
    rules = [(f"(?i)(?:^|[^\\p{{L}}\\p{{N}}_])([0-9]{{1,2}}\\s+{m}\\s+20[0-9]{{2}})(?:[^\\p{{L}}\\p{{N}}_]|$)", f"([0-9]+)\\s+{m}\\s+(20[0-9]{{2}})", 2, f"'{k:02d}'", 1) for k, m in enumerate(dates.MONTHS, 1)]
    rules.append(("(?:^|[^\\p{L}\\p{N}_])([0-9]{1,2}[./][0-9]{1,2}[./]20[0-9]{2})(?:[^\\p{L}\\p{N}_]|$)", "([0-9]+)[./]([0-9]+)[./](20[0-9]{2})", 3, 2, 1))
    rules.append(("(?:^|[^\\p{L}\\p{N}_])(20[0-9]{2}[-.][0-9]{2}[-.][0-9]{2})(?:[^\\p{L}\\p{N}_]|$)", "(20[0-9]{2})[-.]([0-9]+)[-.]([0-9]+)", 1, 2, 3))
    for guard, inner, y, m, d in rules:
        hit = f"regexp_extract({head}, '{guard}', 1)"
        at = f"instr({head}, {hit})"  # from 1
        before = f"lower(substr({head}, greatest({at} - {dates.CUE_CHARS}, 1), least({at} - 1, {dates.CUE_CHARS})))"
        g = lambda k: k if isinstance(k, str) else f"regexp_extract({hit}, '(?i){inner}', {k})"  # noqa: B023, E731
        out.append(f"WHEN {hit} <> '' AND ({at} - 1 <= {dates.HEADER_CHARS} OR regexp_matches({before}, '{cues}')) THEN {_duck_date(g(y), g(m), g(d))}")
    return "CASE " + " ".join(out) + " END"


def duck_dated(source: str, keep: str) -> str:
    """Rows of `source` (with url and text) with the date, its source and its quality, as curation.attach_dates."""
    return f"""
        SELECT {keep}, CASE WHEN NOT late THEN d END AS day, CASE WHEN late THEN 'missing' ELSE s END AS timestamp_source,
            CASE WHEN d IS NULL THEN 'missing' WHEN late THEN 'rejected_future' WHEN s = 'url' THEN 'high' WHEN s = 'text' AND year(d) < {dates.LOW_CONFIDENCE_BEFORE} THEN 'low' WHEN s = 'text' THEN 'medium' ELSE 'missing' END AS timestamp_quality
        FROM (SELECT *, coalesce(CASE WHEN s = 'url' THEN d > DATE '{AS_OF}' + 2 WHEN s = 'text' THEN d > DATE '{AS_OF}' END, false) AS late FROM (
            SELECT *, CASE WHEN u IS NOT NULL THEN 'url' WHEN t IS NOT NULL THEN 'text' ELSE 'missing' END AS s, coalesce(u, t) AS d FROM (SELECT *, {duck_url_date('url')} AS u, {duck_text_date('text')} AS t FROM {source})))"""


@query("D2_url_candidate", f"SELECT row_idx, {duck_candidate('url')} AS found FROM clustered_data WHERE url IS NOT NULL")
def _(spark, d):
    return table(spark, d, "clustered_data").where("url is not null").select("row_idx", dates.candidate_date(F.col("url"), AS_OF).alias("found"))


@query("D6_D7_dated", duck_dated("raw_articles", "row_idx"))
def _(spark, d):
    raw = table(spark, d, "raw_articles").select("row_idx", "url", "text")
    return curation.attach_dates(raw, AS_OF).select("row_idx", "timestamp_source", F.col("timestamp").alias("day"), "timestamp_quality")


# --- curation ---------------------------------------------------------------------------------------------------------


@query("P1_clean_columns", "SELECT row_idx, crawled_at, " + ", ".join(f"{clean(c)} AS {c}" for c in curation.CLEANED) + " FROM raw_articles")
def _(spark, d):
    return curation.clean_columns(table(spark, d, "raw_articles")).select("row_idx", "crawled_at", *curation.CLEANED)


DUCK_DOC = clean("coalesce(title, '') || '. ' || coalesce(text, '')")


@query("P2_P3_documents", f"SELECT row_idx, crawled_at, {DUCK_DOC} AS document, {clean(chr(34).join(['coalesce(title, ' + chr(39) * 2 + ') || ' + chr(39) + '. ' + chr(39) + ' || substr(coalesce(text, ' + chr(39) * 2 + '), 1, 500)']))} AS short_document FROM raw_articles")
def _(spark, d):
    return curation.build_documents(table(spark, d, "raw_articles")).select("row_idx", "crawled_at", "document", "short_document")


@query("U3_first_documents", f"""
    WITH c AS (SELECT row_idx, crawled_at, {clean('title')} AS title, {DUCK_DOC} AS document FROM raw_articles)
    SELECT row_idx, title FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY row_idx, crawled_at) AS r FROM c WHERE title <> '' AND document <> '') WHERE r = 1""")
def _(spark, d):
    df = curation.build_documents(spread(table(spark, d, "raw_articles"))).withColumn("title", text.clean_text(F.col("title"))).withColumn("order", F.struct("row_idx", "crawled_at"))
    return curation.keep_first_documents(df, "order").select("row_idx", "title")


@query("P7_eligible_topics", "SELECT topic_group, count(*) AS n FROM clustered_data GROUP BY topic_group HAVING count(*) >= 200")
def _(spark, d):
    return table(spark, d, "clustered_data").groupBy("topic_group").agg(F.count("*").alias("n")).where("n >= 200")


@query("P11_small_topics_noise", """
    SELECT row_idx, topic_group, CAST(-1 AS BIGINT) AS cluster, CAST(NULL AS FLOAT) AS cluster_membership_strength, 'small_topic_noise' AS cluster_assignment_reason
    FROM clustered_data WHERE topic_group NOT IN (SELECT topic_group FROM clustered_data GROUP BY topic_group HAVING count(*) >= 200)""")
def _(spark, d):
    df = table(spark, d, "clustered_data")
    large = df.groupBy("topic_group").count().where("count >= 200").select("topic_group")
    small = df.join(large, "topic_group", "left_anti")
    return small.select("row_idx", "topic_group", F.lit(-1).cast("long").alias("cluster"), F.lit(None).cast("float").alias("cluster_membership_strength"), F.lit("small_topic_noise").alias("cluster_assignment_reason"))


@query("A1_domain_coverage", """
    SELECT *, 100.0::DOUBLE * (n_rows - n_missing) / n_rows AS coverage_pct FROM (
        SELECT coalesce(source_domain, 'missing') AS domain, count(*) AS n_rows, count(*) FILTER (timestamp_source = 'url') AS n_url, count(*) FILTER (timestamp_source = 'text') AS n_text,
            count(*) FILTER (timestamp_source = 'htmldate') AS n_htmldate, count(*) FILTER (timestamp_source = 'missing') AS n_missing FROM clustered_data GROUP BY 1)""")
def _(spark, d):
    return curation.domain_coverage(table(spark, d, "clustered_data").withColumn("domain", F.coalesce("source_domain", F.lit("missing"))))


@query("T7_weak_domains", """
    SELECT domain, n_rows, round(100.0::DOUBLE * n_dated / n_rows, 6) AS coverage_pct FROM (
        SELECT coalesce(source_domain, 'missing') AS domain, count(*) AS n_rows, count(*) FILTER (timestamp_source <> 'missing') AS n_dated FROM clustered_data GROUP BY 1)
    WHERE n_rows >= 20 ORDER BY 3, n_rows DESC, domain LIMIT 15""")
def _(spark, d):
    cov = curation.domain_coverage(table(spark, d, "clustered_data").withColumn("domain", F.coalesce("source_domain", F.lit("missing"))))
    return cov.where("n_rows >= 20").select("domain", "n_rows", F.round("coverage_pct", 6).alias("coverage_pct")).orderBy("coverage_pct", F.desc("n_rows"), "domain").limit(15)


@query("A2_quality_counts", """
    SELECT q AS timestamp_quality, count(c.row_idx) AS n FROM (VALUES ('high'), ('medium'), ('low'), ('missing'), ('rejected_future')) v(q) LEFT JOIN clustered_data c ON c.timestamp_quality = q GROUP BY q""")
def _(spark, d):
    counts = table(spark, d, "clustered_data").groupBy("timestamp_quality").agg(F.count("*").alias("c"))
    order = spark.createDataFrame([(q,) for q in ("high", "medium", "low", "missing", "rejected_future")], "timestamp_quality string")
    return order.join(counts, "timestamp_quality", "left").select("timestamp_quality", F.coalesce("c", F.lit(0)).alias("n"))


_CD = ("title", "topics", "url", "source_domain", "short_document", "document", "topic_group", "topic_group_reason", "published_at", "timestamp_source", "timestamp_quality", "best_min_cluster_size", "best_min_samples",
       "best_cluster_selection_method", "best_cluster_selection_epsilon", "cluster", "cluster_membership_strength", "cluster_outlier_score", "cluster_assignment_reason", "umap_x", "umap_y", "cluster_size")


@query("A36_missing_values", " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS missing FROM clustered_data" for c in _CD))
def _(spark, d):
    """Missing values of every column, in one pass."""
    return table(spark, d, "clustered_data").agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in _CD]).unpivot([], list(_CD), "name", "missing")


#: The raw articles curated, in SQL: cleaned, dated, with documents, the first row of every document.
CURATED_WITH = """
    cleaned AS (SELECT row_idx, crawled_at, url, {title} AS title, {text} AS text FROM raw_articles),
    raw_tokens AS (SELECT id, w FROM (SELECT id, trim(strip_accents(unnest(string_split(p, ' '))), '.,;:!?"''()…»«/\\') AS w FROM (
            SELECT row_number() OVER () AS id, trim(regexp_replace({whole}, '[\\s\\v\\x{{85}}\\p{{Z}}–—-]+', ' ', 'g')) AS p FROM raw_articles)) WHERE length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+')),
    stop AS (SELECT w FROM raw_tokens GROUP BY w HAVING count(DISTINCT id) * 10 >= (SELECT count(*) FROM raw_articles)),
    dated AS ({dated}),
    documented AS (SELECT *, {document} AS document, {short} AS short_document FROM dated),
    firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY document ORDER BY row_idx, crawled_at) AS r FROM documented WHERE trim(title) <> '' AND trim(document) <> '') WHERE r = 1),
    kept AS (SELECT row_idx, string_agg(w, ' ' ORDER BY i) AS document_nostop FROM (SELECT row_idx, i, trim(strip_accents(w), '.,;:!?"''()…»«/\\') AS w FROM (
            SELECT row_idx, unnest(string_split(p, ' ')) AS w, generate_subscripts(string_split(p, ' '), 1) AS i FROM (
                SELECT row_idx, trim(regexp_replace(document, '[\\s\\v\\x{{85}}\\p{{Z}}–—-]+', ' ', 'g')) AS p FROM firsts))) WHERE length(w) > 2 AND NOT regexp_full_match(w, '[0-9]+') AND w NOT IN (SELECT w FROM stop) GROUP BY row_idx)""".format(
    title=clean("title"), text=clean("text"), whole=clean("coalesce(title, '') || '. ' || coalesce(text, '')"), dated=duck_dated("cleaned", "row_idx, crawled_at, url, title, text"),
    document=clean("title || '. ' || text"), short=clean("title || '. ' || substr(text, 1, 500)"),
)


@query("curated_corpus", f"""
    WITH {CURATED_WITH} SELECT f.row_idx, title, document, short_document, coalesce(document_nostop, '') AS document_nostop, day, timestamp_source, timestamp_quality FROM firsts f LEFT JOIN kept USING (row_idx)""")
def _(spark, d):
    """Curation end to end over the raw articles."""
    raw = table(spark, d, "raw_articles").withColumn("row_idx", F.struct("row_idx", "crawled_at"))
    out = curation.curate(raw, AS_OF)
    return out.select(F.col("row_idx.row_idx").alias("row_idx"), "title", "document", "short_document", "document_nostop", F.col("timestamp").alias("day"), "timestamp_source", "timestamp_quality")


@query("coverage_end_to_end", f"""
    WITH {CURATED_WITH} SELECT domain, count(*) AS n_rows, count(*) FILTER (timestamp_source = 'url') AS n_url, count(*) FILTER (timestamp_source = 'text') AS n_text, CAST(0 AS BIGINT) AS n_htmldate,
        count(*) FILTER (timestamp_source = 'missing') AS n_missing, 100.0::DOUBLE * (count(*) - count(*) FILTER (timestamp_source = 'missing')) / count(*) AS coverage_pct
    FROM (SELECT timestamp_source, CASE WHEN u = '' OR h = '' THEN 'missing' ELSE h END AS domain FROM (
        SELECT timestamp_source, u, regexp_replace({DUCK_HOST.format("CASE WHEN contains(u, '://') THEN u ELSE 'http://' || u END")}, '^www\\.', '') AS h FROM (SELECT timestamp_source, trim(coalesce(url, '')) AS u FROM firsts))) GROUP BY domain""")
def _(spark, d):
    """Coverage by site over the curated raw articles."""
    raw = table(spark, d, "raw_articles").withColumn("row_idx", F.struct("row_idx", "crawled_at"))
    curated = curation.curate(raw, AS_OF, stopwords=())
    return curation.domain_coverage(curated.withColumn("domain", urls.report_domain(F.col("url"))))


# --- temporal ---------------------------------------------------------------------------------------------------------


def _burst_sql(step: int) -> str:
    bucket = "CAST(ts AS DATE)" if step == 1 else "CAST(date_trunc('week', CAST(ts AS DATE) - INTERVAL 1 DAY) + INTERVAL 1 DAY AS DATE)"
    return f"""
        b AS (SELECT cluster, {bucket} AS bucket, count(*) AS c FROM articles WHERE ts IS NOT NULL AND cluster <> -1 GROUP BY 1, 2),
        m AS (SELECT *, CAST(sum(c) OVER w AS DOUBLE) AS n, datediff('day', min(bucket) OVER w, max(bucket) OVER w) / {step}.0::DOUBLE + 1 AS t FROM b WINDOW w AS (PARTITION BY cluster)),
        l AS (SELECT *, CASE WHEN n >= 3 AND t >= 2 AND c * (ln(2 * n / t + 1e-10::DOUBLE) - ln(n / t + 1e-10::DOUBLE)) - n / t - 1 > 0 THEN 1 ELSE 0 END AS level FROM m),
        i AS (SELECT *, datediff('day', DATE '1970-01-01', bucket) // {step} - row_number() OVER (PARTITION BY cluster ORDER BY bucket) AS g FROM l WHERE level = 1)"""


for _step, _name in ((1, "daily"), (7, "weekly")):

    @query(f"B1_levels_{_name}", f"WITH {ARTICLES}, {_burst_sql(_step)} SELECT cluster, bucket, c, level FROM l")
    def _(spark, d, step=_step):
        return temporal.burst_levels(temporal.bucket_counts(articles(spark, d).where("cluster <> -1"), step), step)

    @query(f"B4_periods_{_name}", f'WITH {ARTICLES}, {_burst_sql(_step)} SELECT cluster, min(bucket) AS start, max(bucket) AS "end", count(*) AS buckets FROM i GROUP BY cluster, g')
    def _(spark, d, step=_step):
        return temporal.burst_periods(temporal.burst_levels(temporal.bucket_counts(articles(spark, d).where("cluster <> -1"), step), step), step)

    @query(f"B5_durations_{_name}", f"WITH {ARTICLES}, {_burst_sql(_step)} SELECT cluster, CAST(1 AS BIGINT) AS score, count(DISTINCT g) AS periods, count(*) AS duration FROM i GROUP BY cluster")
    def _(spark, d, step=_step):
        return temporal.burst_summary(articles(spark, d).where("cluster <> -1"), step)


@query("B3_dense_calendar", f"WITH {ARTICLES}, {_burst_sql(1)} SELECT cluster, bucket, c FROM l WHERE level = 1")
def _(spark, d):
    return temporal.dense_levels(articles(spark, d).where("cluster <> -1"), 1).where("level = 1").select("cluster", "bucket", "c")


@query("A15_entropy", f"""
    WITH {ARTICLES}, n AS (SELECT cluster, domain, count(*) AS n FROM articles WHERE cluster <> -1 GROUP BY 1, 2),
        p AS (SELECT cluster, n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) AS p FROM n)
    SELECT cluster, CASE WHEN count(*) <= 1 THEN 0.0::DOUBLE ELSE round(sum(-p * ln(p + 1e-12::DOUBLE)) / ln(count(*)), 4) END AS entropy FROM p GROUP BY cluster""")
def _(spark, d):
    n = articles(spark, d).where("cluster <> -1").groupBy("cluster", "domain").agg(F.count("*").alias("n"))
    return temporal.normalized_entropy(n, "cluster", "n")


@query("A13_spread", f"""
    WITH {ARTICLES}, f AS (SELECT cluster, min(ts) AS f, max(ts) AS l FROM articles WHERE ts IS NOT NULL AND cluster <> -1 GROUP BY 1)
    SELECT a.cluster, round(coalesce(stddev_samp(floor((epoch_us(ts) - epoch_us(f)) / 86400000000)), 0.0), 6) AS spread,
        CAST(greatest(floor((epoch_us(max(l)) - epoch_us(max(f))) / 86400000000), 1) AS BIGINT) AS span_days
    FROM articles a JOIN f USING (cluster) WHERE ts IS NOT NULL GROUP BY a.cluster""")
def _(spark, d):
    p = temporal.profile(articles(spark, d))
    return p.select("cluster", F.round("temporal_spread_days", 6).alias("spread"), "span_days")


@query("A14_domain_shares", f"""
    WITH {ARTICLES}, n AS (SELECT cluster, domain, count(*) AS n, count(ts) AS nd FROM articles WHERE cluster <> -1 GROUP BY 1, 2)
    SELECT cluster, count(*) AS domain_count, round(max(n) / CAST(sum(n) AS DOUBLE), 6) AS top_share, count(*) FILTER (nd > 0) AS dated_domains, round(max(nd) / CAST(greatest(sum(nd), 1) AS DOUBLE), 6) AS top_dated_share
    FROM n GROUP BY cluster HAVING sum(nd) > 0""")
def _(spark, d):
    p = temporal.profile(articles(spark, d))
    return p.select("cluster", "domain_count", F.round("top_domain_share", 6).alias("top_share"), F.col("timestamped_domain_count").alias("dated_domains"), F.round("top_timestamp_domain_share", 6).alias("top_dated_share"))


@query("A16_source_shares", f"""
    WITH {ARTICLES} SELECT cluster, round(count(*) FILTER (s = 'url') / count(*)::DOUBLE, 6) AS url_share, round(count(*) FILTER (s = 'text') / count(*)::DOUBLE, 6) AS text_share, round(count(*) FILTER (s = 'missing') / count(*)::DOUBLE, 6) AS missing_share,
        round((count(*) FILTER (s = 'url') + 0.35::DOUBLE * count(*) FILTER (s = 'text')) / count(*), 6) AS reliability
    FROM (SELECT *, lower(coalesce(timestamp_source, 'missing')) AS s FROM articles WHERE cluster <> -1) GROUP BY cluster HAVING count(ts) > 0""")
def _(spark, d):
    p = temporal.profile(articles(spark, d))
    share = lambda c: F.round(f"timestamp_source_{c}_share", 6).alias(f"{c}_share")
    return p.select("cluster", share("url"), share("text"), share("missing"), F.round("timestamp_source_reliability", 6).alias("reliability"))


@query("A17_W6_gaps", f"""
    WITH {ARTICLES}, d AS (SELECT DISTINCT cluster, CAST(ts AS DATE) AS day FROM articles WHERE ts IS NOT NULL AND cluster <> -1),
        g AS (SELECT cluster, greatest(datediff('day', lag(day) OVER (PARTITION BY cluster ORDER BY day), day) - 1, 0) AS gap, lag(day) OVER (PARTITION BY cluster ORDER BY day) AS prev FROM d)
    SELECT cluster, coalesce(median(gap) FILTER (prev IS NOT NULL), 0.0) AS median_gap_days, CAST(coalesce(max(gap) FILTER (prev IS NOT NULL), 0) AS DOUBLE) AS max_gap_days FROM g GROUP BY cluster""")
def _(spark, d):
    return temporal.profile(articles(spark, d)).select("cluster", "median_gap_days", "max_gap_days")


@query("A9_topic_mode", f"""
    WITH {ARTICLES}, n AS (SELECT cluster, topic_group, count(*) AS n FROM articles WHERE cluster <> -1 AND ts IS NOT NULL GROUP BY 1, 2)
    SELECT cluster, topic_group FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic_group) AS r FROM n) WHERE r = 1""")
def _(spark, d):
    return temporal.profile(articles(spark, d)).select("cluster", "topic_group")


@query("B6_profile", f"""
    WITH {ARTICLES}, {_burst_sql(1)},
        d AS (SELECT cluster, count(*) AS active_days, max(c) AS peak FROM b GROUP BY 1),
        a AS (SELECT cluster, count(*) AS total, count(ts) AS n, min(ts) AS f, max(ts) AS t FROM articles WHERE cluster <> -1 GROUP BY 1 HAVING count(ts) > 0),
        s AS (SELECT *, greatest(floor((epoch_us(t) - epoch_us(f)) / 86400000000), 1) AS span FROM a JOIN d USING (cluster))
    SELECT cluster, total AS total_articles, n AS timestamped_articles, active_days, peak AS peak_day_count, CAST(f AS DATE) AS first_seen, CAST(t AS DATE) AS last_seen,
        round(n / total::DOUBLE, 6) AS coverage, round(active_days / span, 6) AS active_day_ratio, round(peak / n::DOUBLE, 6) AS peak_share, round(peak / greatest(n / span, 1e-9), 6) AS peak_to_baseline,
        round(n / span, 6) AS concentration, round(active_days / span * n / total, 6) AS compactness FROM s""")
def _(spark, d):
    p = temporal.profile(articles(spark, d))
    r = lambda c, n: F.round(c, 6).alias(n)
    return p.select("cluster", "total_articles", "timestamped_articles", "active_days", "peak_day_count", "first_seen", "last_seen", r("timestamp_coverage_ratio", "coverage"), r("active_day_ratio", "active_day_ratio"), r("peak_day_share", "peak_share"), r("peak_to_baseline_ratio", "peak_to_baseline"), r("concentration", "concentration"), r("compactness_index", "compactness"))


_PEN = """0.75::DOUBLE * greatest(0, 6 - timestamped_articles) AS p1,
    ln(1 + span_days) * greatest(0, span_days - 90) / 90 * (1 - active_day_ratio) * (1 - timestamp_coverage_ratio) * 1.8::DOUBLE AS p2,
    4 * greatest(0.0::DOUBLE, top_domain_share - 0.5) + CASE WHEN domain_count = 1 THEN 1.75 ELSE 0 END + 2 * greatest(0.0::DOUBLE, top_timestamp_domain_share - 0.6) AS p3,
    3 * (1 - timestamp_source_reliability) AS p4, 3 * greatest(0.0::DOUBLE, 0.20::DOUBLE - active_day_ratio) AS p5"""
_RAW = """4 * burst_score_daily + 3 * burst_score_weekly + 4 * burst_stable + 2 * ln(1 + concentration) + 2.5::DOUBLE * ln(1 + peak_to_baseline_ratio) + 3 * peak_day_share
    + 2.5::DOUBLE * burst_duration_share_daily + 1.5::DOUBLE * burst_duration_share_weekly + 0.75::DOUBLE * ln(1 + total_articles)"""
_GATES = """least(1, timestamped_articles / 10.0::DOUBLE) * least(1, 0.35::DOUBLE + 0.65::DOUBLE * timestamp_coverage_ratio) * (0.45::DOUBLE + 0.55::DOUBLE * least(1, timestamp_source_reliability))
    * (0.60::DOUBLE + 0.40::DOUBLE * least(1, 1 - greatest(0, top_domain_share - 0.5)))"""


@query("B7_suspicion", f"""
    SELECT cluster, round(({_RAW}), 6) AS raw, round(greatest(0.0::DOUBLE, ({_RAW}) * {_GATES} - (p1 + p2 + p3 + p4 + p5)), 5) AS score FROM (SELECT *, {_PEN} FROM cluster_temporal_stats)""")
def _(spark, d):
    """The score formula over stored measures (5 decimals, so that rounding habits do not matter)."""
    s = temporal.suspicion(stats(spark, d))
    off = F.col("support_penalty") + F.col("long_sparse_span_penalty") + F.col("single_domain_penalty") + F.col("source_reliability_penalty") + F.col("compact_penalty")
    gated = F.col("suspicion_score_raw") * F.col("support_weight") * F.col("coverage_weight") * F.col("source_weight") * F.col("domain_weight")
    return s.select("cluster", F.round("suspicion_score_raw", 6).alias("raw"), F.round(F.greatest(F.lit(0.0), gated - off), 5).alias("score"))


#: Profiles with their scores, in SQL.
PROFILE_WITH = f"""
    {ARTICLES}, real AS (SELECT * FROM articles WHERE cluster <> -1),
    {_burst_sql(1).replace('b AS', 'bd AS').replace('FROM b ', 'FROM bd ').replace('m AS', 'md AS').replace('FROM m)', 'FROM md)').replace('l AS', 'ld AS').replace('FROM l ', 'FROM ld ').replace('i AS', 'id AS')},
    {_burst_sql(7).replace('b AS', 'bw AS').replace('FROM b ', 'FROM bw ').replace('m AS', 'mw AS').replace('FROM m)', 'FROM mw)').replace('l AS', 'lw AS').replace('FROM l ', 'FROM lw ').replace('i AS', 'iw AS')},
    daily AS (SELECT cluster, CAST(1 AS BIGINT) AS score, count(DISTINCT g) AS periods, count(*) AS duration FROM id GROUP BY 1), weekly AS (SELECT cluster, CAST(1 AS BIGINT) AS score, count(DISTINCT g) AS periods, count(*) AS duration FROM iw GROUP BY 1),
    base AS (SELECT cluster, count(*) AS total_articles, count(ts) AS n, min(ts) AS f, max(ts) AS t, count(*) FILTER (lower(timestamp_source) = 'url') AS nu, count(*) FILTER (lower(timestamp_source) = 'text') AS nt, count(*) FILTER (lower(coalesce(timestamp_source, 'missing')) = 'missing') AS nm FROM real GROUP BY 1 HAVING count(ts) > 0),
    act AS (SELECT cluster, count(*) AS active_days, max(c) AS peak FROM bd GROUP BY 1),
    pd AS (SELECT cluster, domain, count(*) AS n, count(ts) AS nd FROM real GROUP BY 1, 2),
    dom AS (SELECT cluster, count(*) AS domain_count, max(n) / CAST(sum(n) AS DOUBLE) AS top_share, max(nd) / CAST(greatest(sum(nd), 1) AS DOUBLE) AS top_dated, count(*) FILTER (nd > 0) AS dated_domains FROM pd GROUP BY 1),
    top AS (SELECT cluster, topic_group FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, topic_group) AS r FROM (SELECT cluster, topic_group, count(*) AS n FROM real WHERE ts IS NOT NULL GROUP BY 1, 2)) WHERE r = 1),
    prof AS (SELECT base.*, active_days, peak, domain_count, top_share, top_dated, dated_domains, topic_group, greatest(floor((epoch_us(t) - epoch_us(f)) / 86400000000), 1) AS span, n / total_articles::DOUBLE AS cover, nu / total_articles::DOUBLE + 0.35::DOUBLE * (nt / total_articles::DOUBLE) AS rel,
            coalesce(daily.score, 0) AS bsd, coalesce(daily.periods, 0) AS bpd, coalesce(daily.duration, 0) AS bdd, coalesce(weekly.score, 0) AS bsw, coalesce(weekly.periods, 0) AS bpw, coalesce(weekly.duration, 0) AS bdw
        FROM base JOIN act USING (cluster) JOIN dom USING (cluster) JOIN top USING (cluster) LEFT JOIN daily ON daily.cluster = base.cluster LEFT JOIN weekly ON weekly.cluster = base.cluster),
    terms AS (SELECT *, active_days / span AS adr, n / span AS conc FROM prof),
    scored AS (SELECT *, 4 * bsd + 3 * bsw + 4 * CASE WHEN bdd > 0 AND bdw > 0 THEN 1 ELSE 0 END + 2 * ln(1 + conc) + 2.5::DOUBLE * ln(1 + peak / greatest(conc, 1e-9::DOUBLE)) + 3 * (peak / greatest(n, 1)::DOUBLE) + 2.5::DOUBLE * (bdd / span)
            + 1.5::DOUBLE * least(7 * bdw / span, 1) + 0.75::DOUBLE * ln(1 + total_articles) AS raw,
        least(1, n / 10.0::DOUBLE) * least(1, 0.35::DOUBLE + 0.65::DOUBLE * cover) * (0.45::DOUBLE + 0.55::DOUBLE * least(1, rel)) * (0.60::DOUBLE + 0.40::DOUBLE * least(1, 1 - greatest(0, top_share - 0.5))) AS gate,
        0.75::DOUBLE * greatest(0, 6 - n) + ln(1 + span) * greatest(0, span - 90) / 90 * (1 - adr) * (1 - cover) * 1.8::DOUBLE + 4 * greatest(0.0::DOUBLE, top_share - 0.5) + CASE WHEN domain_count = 1 THEN 1.75 ELSE 0 END
            + 2 * greatest(0.0::DOUBLE, top_dated - 0.6) + 3 * (1 - rel) + 3 * greatest(0.0::DOUBLE, 0.20::DOUBLE - adr) AS pen FROM terms)"""


@query("B7_scored_profiles", f"""
    WITH {PROFILE_WITH} SELECT cluster, topic_group, total_articles, n AS timestamped_articles, CAST(span AS BIGINT) AS span_days, active_days, domain_count, bsd AS burst_score_daily, bsw AS burst_score_weekly, round(rel, 6) AS reliability, round(raw, 5) AS raw,
        round(pen, 4) AS penalty, round(greatest(0.0::DOUBLE, raw * gate - pen), 3) AS suspicion_score FROM scored""")
def _(spark, d):
    """Profiles of the articles with their scores."""
    s = temporal.suspicion(temporal.profile(articles(spark, d)))
    return s.select("cluster", "topic_group", "total_articles", "timestamped_articles", "span_days", "active_days", "domain_count", "burst_score_daily", "burst_score_weekly", F.round("timestamp_source_reliability", 6).alias("reliability"), F.round("suspicion_score_raw", 5).alias("raw"), F.col("suspicion_penalty_total").alias("penalty"), "suspicion_score")


# DuckDB rounds doubles by multiplying, which lifts a value just below a half (source_weight): as a decimal it is rounded as it stands
@query("B6_temporal_table", f"""
    WITH {PROFILE_WITH}, gaps AS (SELECT cluster, greatest(datediff('day', lag(bucket) OVER (PARTITION BY cluster ORDER BY bucket), bucket) - 1, 0) AS gap, lag(bucket) OVER (PARTITION BY cluster ORDER BY bucket) AS prev FROM bd),
        gap AS (SELECT cluster, coalesce(median(gap) FILTER (prev IS NOT NULL), 0.0) AS med, CAST(coalesce(max(gap) FILTER (prev IS NOT NULL), 0) AS DOUBLE) AS mx FROM gaps GROUP BY 1),
        ent AS (SELECT cluster, CASE WHEN count(*) <= 1 THEN 0.0::DOUBLE ELSE round(sum(-p * ln(p + 1e-12::DOUBLE)) / ln(count(*)), 4) END AS entropy FROM (SELECT cluster, n / CAST(sum(n) OVER (PARTITION BY cluster) AS DOUBLE) AS p FROM pd) GROUP BY 1),
        spr AS (SELECT r.cluster, coalesce(stddev_samp(floor((epoch_us(ts) - epoch_us(f)) / 86400000000)), 0.0) AS spread FROM real r JOIN base USING (cluster) WHERE ts IS NOT NULL GROUP BY 1),
        ttl AS (SELECT cluster, left(coalesce(arg_min(coalesce(title, ''), row_idx), ''), 200) AS title FROM real GROUP BY 1)
    SELECT cluster, topic_group, total_articles, n AS timestamped_articles, round(cover, 4) AS timestamp_coverage_ratio, round(nu / total_articles::DOUBLE, 4) AS timestamp_source_url_share, round(nt / total_articles::DOUBLE, 4) AS timestamp_source_text_share,
        round(nm / total_articles::DOUBLE, 4) AS timestamp_source_missing_share, round(rel, 4) AS timestamp_source_reliability, domain_count, round(top_share, 4) AS top_domain_share, dated_domains AS timestamped_domain_count, round(top_dated, 4) AS top_timestamp_domain_share, entropy AS domain_entropy,
        CAST(f AS DATE) AS first_seen, CAST(t AS DATE) AS last_seen, CAST(span AS BIGINT) AS span_days, round(spread, 2) AS temporal_spread_days, active_days, round(adr, 4) AS active_day_ratio, round(med, 2) AS median_gap_days, round(mx, 2) AS max_gap_days, round(span / n, 4) AS days_per_timestamped_article,
        round(adr * cover, 4) AS compactness_index, peak AS peak_day_count, round(peak / n::DOUBLE, 4) AS peak_day_share, round(peak / greatest(conc, 1e-9::DOUBLE), 4) AS peak_to_baseline_ratio, bsd AS burst_score_daily, bdd AS burst_duration_daily, bpd AS burst_periods_daily, round(bdd / span, 4) AS burst_duration_share_daily,
        bsw AS burst_score_weekly, bdw AS burst_duration_weekly, bpw AS burst_periods_weekly, round(least(7 * bdw / span, 1), 4) AS burst_duration_share_weekly, CASE WHEN bdd > 0 AND bdw > 0 THEN 1 ELSE 0 END AS burst_stable, round(conc, 4) AS concentration, round(least(1, n / 10.0::DOUBLE), 4) AS support_weight,
        round(least(1, 0.35::DOUBLE + 0.65::DOUBLE * cover), 4) AS coverage_weight, CAST(round(CAST(0.45::DOUBLE + 0.55::DOUBLE * least(1, rel) AS DECIMAL(38, 16)), 4) AS DOUBLE) AS source_weight, round(0.60::DOUBLE + 0.40::DOUBLE * least(1, 1 - greatest(0, top_share - 0.5)), 4) AS domain_weight,
        round(ln(1 + span) * greatest(0, span - 90) / 90 * (1 - adr) * (1 - cover) * 1.8::DOUBLE, 4) AS long_sparse_span_penalty, round(4 * greatest(0.0::DOUBLE, top_share - 0.5) + CASE WHEN domain_count = 1 THEN 1.75 ELSE 0 END + 2 * greatest(0.0::DOUBLE, top_dated - 0.6), 4) AS single_domain_penalty,
        round(3 * (1 - rel), 4) AS source_reliability_penalty, round(raw, 4) AS suspicion_score_raw, round(pen, 4) AS suspicion_penalty_total, round(greatest(0.0::DOUBLE, raw * gate - pen), 3) AS suspicion_score, title AS representative_title, bsd AS burst_score, bdd AS burst_duration_days,
        total_articles AS article_count, bpd AS num_burst_periods
    FROM scored JOIN gap USING (cluster) JOIN ent USING (cluster) JOIN spr USING (cluster) JOIN ttl USING (cluster)""")
def _(spark, d):
    """The temporal table of the articles, without its campaign columns (which B8 and B14 check)."""
    return temporal.temporal_table(articles(spark, d)).select(*temporal.TABLE_COLUMNS)


REPAIRED_SQL = f"""
    SELECT cluster, burst_periods_daily >= 5 AND total_articles >= 50 AND active_days >= 20 AND domain_count >= 3 AS robust_recurring,
        round(greatest(0.0::DOUBLE, suspicion_score_raw * support_weight * coverage_weight * source_weight * domain_weight - (coalesce(suspicion_penalty_total, 0) - coalesce(long_sparse_span_penalty, 0)
            + CASE WHEN burst_periods_daily >= 5 AND total_articles >= 50 AND active_days >= 20 AND domain_count >= 3 THEN 0.0 ELSE p2 END)), 3) AS repaired_score
    FROM (SELECT *, {_PEN} FROM cluster_temporal_stats)"""


@query("B9_multiyear_repair", REPAIRED_SQL)
def _(spark, d):
    return temporal.multiyear_repair(stats(spark, d)).select("cluster", "robust_recurring", "repaired_score")


@query("B11_burst_off", """
    SELECT cluster, round(greatest(0.0::DOUBLE, (coalesce(suspicion_score_raw, 0) - (4 * coalesce(burst_score_daily, 0) + 3 * coalesce(burst_score_weekly, 0) + 4 * coalesce(burst_stable, 0)))
        * (coalesce(support_weight, 0) * coalesce(coverage_weight, 0) * coalesce(source_weight, 0) * coalesce(domain_weight, 0)) - coalesce(suspicion_penalty_total, 0)), 5) AS off FROM cluster_temporal_stats""")
def _(spark, d):
    return temporal.burst_off(stats(spark, d)).select("cluster", F.round("score_without_bursts", 5).alias("off"))


@query("B12_multi_source", "SELECT cluster, CASE WHEN domain_count > 1 THEN suspicion_score ELSE 0.0 END AS multi_source_score FROM cluster_temporal_stats")
def _(spark, d):
    return stats(spark, d).select("cluster", F.when(F.col("domain_count") > 1, F.col("suspicion_score")).otherwise(0.0).alias("multi_source_score"))


@query("B13_decomposition", """
    SELECT cluster, suspicion_score_raw AS raw, round(suspicion_score_raw * support_weight * coverage_weight * source_weight * domain_weight, 6) AS gated, suspicion_score, campaign_candidate_score
    FROM cluster_temporal_stats ORDER BY campaign_candidate_score DESC NULLS LAST, cluster LIMIT 12""")
def _(spark, d):
    g = F.col("suspicion_score_raw") * F.col("support_weight") * F.col("coverage_weight") * F.col("source_weight") * F.col("domain_weight")
    s = stats(spark, d).orderBy(F.desc_nulls_last("campaign_candidate_score"), "cluster").limit(12)
    return s.select("cluster", F.col("suspicion_score_raw").alias("raw"), F.round(g, 6).alias("gated"), "suspicion_score", "campaign_candidate_score")


@query("top_bursty_clusters", f"""
    WITH {PROFILE_WITH} SELECT cluster, topic_group, total_articles, n AS timestamped_articles, CAST(span AS BIGINT) AS span_days, bsd AS burst_score_daily, bpd AS burst_periods_daily, bsw AS burst_score_weekly, domain_count,
        round(greatest(0.0::DOUBLE, raw * gate - pen), 3) AS suspicion_score FROM scored ORDER BY suspicion_score DESC, cluster LIMIT 20""")
def top_bursty(spark, d):
    return temporal.top_bursty(articles(spark, d))


@query("H_orders_bursts", """
    WITH b AS (SELECT o_custkey AS cluster, CAST(o_orderdate AS DATE) AS bucket, count(*) AS c FROM orders GROUP BY 1, 2),
        m AS (SELECT *, CAST(sum(c) OVER w AS DOUBLE) AS n, datediff('day', min(bucket) OVER w, max(bucket) OVER w) + 1.0::DOUBLE AS t FROM b WINDOW w AS (PARTITION BY cluster))
    SELECT cluster, count(*) AS buckets FROM m WHERE n >= 3 AND t >= 2 AND c * (ln(2 * n / t + 1e-10::DOUBLE) - ln(n / t + 1e-10::DOUBLE)) - n / t - 1 > 0 GROUP BY cluster""")
def _(spark, d):
    """The burst operator at the size of `orders`."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("cluster"), F.col("o_orderdate").alias("ts"))
    return temporal.burst_levels(temporal.bucket_counts(o, 1), 1).where("level = 1").groupBy("cluster").agg(F.count("*").alias("buckets"))
