import unicodedata

from pyspark.sql import functions as F

from newsgrain.functions import dates, text, topics, urls

AS_OF = "2024-06-30"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "c string").select(expr(F.col("c")).alias("x")).first()["x"]


def test_clean_text(spark):
    assert one(spark, None, text.clean_text) == ""
    assert one(spark, "", text.clean_text) == ""
    assert one(spark, "  Ana are\n\n MERE 🙂 ", text.clean_text) == "ana are mere"


def test_clean_text_idempotent(spark):
    assert one(spark, one(spark, " A \t B🔴c ", text.clean_text), text.clean_text) == one(spark, " A \t B🔴c ", text.clean_text)


def test_strip_diacritics(spark):
    s = "ăîâșțŞŢ ă йё έ ﬁ"
    want = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    assert one(spark, s, text.strip_diacritics_exact) == want
    assert one(spark, s, text.strip_diacritics) == want.replace("fi", "ﬁ")
    assert one(spark, None, text.strip_diacritics_exact) is None


def test_tokens_and_stopwords(spark):
    assert one(spark, "Într-un „sat” – 2021, casă!", lambda c: text.remove_stopwords(c, ["sat"])) == "Intr „sat” casa".replace("„sat”", "„sat”")
    assert one(spark, None, lambda c: text.remove_stopwords(c, [])) == ""


def test_whole_terms_against_substrings(spark):
    assert not one(spark, "presedinte ales", lambda c: text.contains_any(c, ("presed",)))
    assert one(spark, "presedinte ales", lambda c: text.contains_substring(c, ("presed",)))


def test_safe_name_and_shorten(spark):
    assert one(spark, " știri / interne ", text.safe_name) == "tiri_interne"
    assert one(spark, "a" * 70, text.shorten) == "a" * 59 + "…"


def test_topics(spark):
    cases = {None: "necunoscut", "": "necunoscut", "N/A": "necunoscut", "Politică": "politica", "în lume": "international", "it-știință": "stiinta", "foo, sport": "sport", "bani si sport": "economie", "altceva": "altceva"}
    for raw, want in cases.items():
        assert one(spark, raw, topics.normalize_topic) == want, raw
    assert one(spark, "root", topics.topic_reason) == "metadata_topic"
    assert one(spark, "sport", topics.topic_reason) == "canonical_topic"
    assert one(spark, "foo, sport", topics.topic_reason) == "composite_topic"


def test_domains(spark):
    url = "https://user@www.Site.md:8080/a?b"
    assert one(spark, url, urls.report_domain) == "user@www.site.md:8080"
    assert one(spark, url, urls.temporal_domain) == "site.md"
    assert one(spark, "site.md/a", urls.temporal_domain) == "unknown_domain"
    assert one(spark, "www.site.md/a", urls.serving_domain) == "site.md"
    assert one(spark, None, urls.report_domain) == "missing"
    assert one(spark, None, urls.serving_domain) == ""


def test_query_map(spark):
    assert one(spark, "A=1&b=&a=2", urls.query_map) == {"b": "", "a": "2"}


def test_url_dates(spark):
    d = lambda u: str(one(spark, u, lambda c: dates.url_date(c, AS_OF)))
    assert d("https://a.b/2021/03/23/x") == "2021-03-23"
    assert d("a.b/x-23.3.2021") == "2021-03-23"
    assert d("https://a.b/20210323") == "2021-03-23"
    assert d("https://a.b/x?year=2021&month=3&day=5") == "2021-03-05"
    assert d("https://a.b/x?Date=2021-03-05&z=1") == "2021-03-05"
    assert d("https://a.b/x#2021/3/5") == "2021-03-05"
    assert d("https://a.b/2021/02/31/20210323") == "None"  # the first pattern that matches decides
    assert d("https://a.b/2014/03/03") == "None"
    assert d("https://a.b/2026/03/03") == "None"
    assert d(None) == "None"


def test_text_dates(spark):
    d = lambda t: str(one(spark, t, lambda c: dates.text_date(c, AS_OF)))
    assert d("Chișinău, 23 Martie 2021. Text") == "2021-03-23"
    assert d("x" * 130 + " 23.03.2021") == "None"
    assert d("x" * 130 + " publicat la 23.03.2021") == "2021-03-23"
    assert d("2021-03-23 ora") == "2021-03-23"
    assert d("31.02.2021 apoi 2021-03-23") == "None"
    assert d(None) == "None"


def test_weeks(spark):
    x = spark.sql("select explode(sequence(date'2024-01-01', date'2024-01-16')) d").select("d", dates.tuesday_week(F.col("d")).alias("t"), dates.sunday_week(F.col("d")).alias("s")).collect()
    for r in x:
        assert r["t"].weekday() == 1 and 0 <= (r["d"] - r["t"]).days < 7
        assert r["s"].weekday() == 6 and 0 <= (r["s"] - r["d"]).days < 7
