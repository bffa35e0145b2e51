"""Dates out of links and text headers, and calendar buckets.

`as_of` takes the place of today's date, so results do not depend on when a query runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import unquote

#: Month names in calendar order.
MONTHS = ("ianuarie", "februarie", "martie", "aprilie", "mai", "iunie", "iulie", "august", "septembrie", "octombrie", "noiembrie", "decembrie")
#: Fixed value: the first year that is believed.
MIN_YEAR = 2015
#: Characters of a text that are searched, that are its header, and that may hold a cue before a date.
SCAN_CHARS, HEADER_CHARS, CUE_CHARS = 220, 120, 35
#: Words before a date of publication.
CUES = ("publicat", "publicata", "publicată", "actualizat", "actualizata", "actualizată", "updated", "data", "ora")
#: Parameters of a link that hold a date.
QUERY_KEYS = ("date", "datetime", "published", "pubdate", "publish_date", "publishdate", "timestamp", "time", "created", "updated", "article_date", "news_date")
#: Dates in links.
YMD = r"(?<!\d)(20\d{2})[/._-](0?[1-9]|1[0-2])[/._-](0?[1-9]|[12]\d|3[01])(?!\d)"
DMY = r"(?<!\d)(0?[1-9]|[12]\d|3[01])[/._-](0?[1-9]|1[0-2])[/._-](20\d{2})(?!\d)"
COMPACT = r"(?<!\d)(20\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?!\d)"
#: Dates in the head of a text.
DAY_FIRST = r"\b(\d{1,2})[./](\d{1,2})[./](20\d{2})\b"
YEAR_FIRST = r"\b(20\d{2})[-.](\d{2})[-.](\d{2})\b"
#: The year before which a date in a text is of low quality, and the days a date may lie ahead.
LOW_CONFIDENCE_BEFORE = 2018
FUTURE_DAYS = {"url": 2, "text": 0}


def build_date(year: Column, month: Column, day: Column, as_of: str) -> Column:
    """A calendar date from MIN_YEAR to the year after `as_of`, else null."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    date = F.try_to_date(text, "yyyy-MM-dd")
    return F.when(F.year(date).between(MIN_YEAR, int(as_of[:4]) + 1), date)


def candidate_date(c: Column, as_of: str) -> Column:
    """The date in a path or value. The first pattern that matches decides, even where its date does not exist."""
    part = lambda p, *order: build_date(*[F.regexp_extract(c, p, i) for i in order], as_of)
    return F.when(c.rlike(YMD), part(YMD, 1, 2, 3)).when(c.rlike(DMY), part(DMY, 3, 2, 1)).when(c.rlike(COMPACT), part(COMPACT, 1, 2, 3))


def query_date(query: Column, as_of: str) -> Column:
    """The date in a query string: year, month and day parameters, else the first dated one of the known names."""
    value = lambda name: F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    parts = build_date(value("year"), value("month"), value("day"), as_of)
    has_parts = (value("year") != "") & (value("month") != "") & (value("day") != "")
    entries = F.filter(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*QUERY_KEYS))
    dates = F.filter(F.transform(entries, lambda p: candidate_date(unquote(F.regexp_replace(p, "^[^=]*=?", "")), as_of)), lambda d: d.isNotNull())
    return F.when(has_parts, parts).otherwise(F.get(dates, F.lit(0)))


def url_date(url: Column, as_of: str) -> Column:
    """The date in a link: its path, else its fragment, its query, the whole link."""
    u = unquote(url)
    rest = F.regexp_replace(F.when(F.contains(u, F.lit("://")), u).otherwise(F.concat(F.lit("http://"), u)), r"^[^:]*://[^/?#]*", "")
    path, query, fragment = F.regexp_extract(rest, r"^([^?#]*)", 1), F.regexp_extract(rest, r"\?([^#]*)", 1), F.regexp_extract(rest, r"#(.*)$", 1)
    found = F.coalesce(candidate_date(path, as_of), candidate_date(fragment, as_of), query_date(query, as_of), candidate_date(u, as_of))
    return F.when(u.rlike("20|%"), found)  # every date has a year of this century, written plainly or encoded once more


def text_date(text: Column, as_of: str) -> Column:
    """The date in the head of a text: month names in calendar order, then d.m.y, then ISO.

    A match counts near the beginning or after a cue word; the first pattern whose match counts decides.
    """
    head = F.substring(text, 1, SCAN_CHARS)
    low = F.lower(head)
    rules = [(rf"(?iu)\b(\d{{1,2}})\s+{m}\s+(20\d{{2}})\b", low.contains(m), 2, F.lit(f"{k:02d}"), 1) for k, m in enumerate(MONTHS, 1)]
    rules += [(DAY_FIRST, F.lit(True), 3, 2, 1), (YEAR_FIRST, F.lit(True), 1, 2, 3)]
    # every pattern is a literal, so that each is compiled once, and is tried only where a year stands at all
    found = F.when(~F.coalesce(head.rlike(r"20\d{2}"), F.lit(False)), F.lit(None).cast("date"))
    for pattern, possible, y, m, d in rules:
        group = lambda g: F.regexp_extract(head, pattern, g) if isinstance(g, int) else g  # noqa: B023, E731
        at = F.regexp_instr(head, F.lit(pattern)) - 1
        before = F.lower(F.substr(head, F.greatest(at - CUE_CHARS, F.lit(0)) + 1, F.greatest(F.least(at, F.lit(CUE_CHARS)), F.lit(0))))
        counts = possible & (at >= 0) & ((at <= HEADER_CHARS) | before.rlike("|".join(CUES)))
        found = found.when(counts, build_date(group(y), group(m), group(d), as_of))
    return found


def timestamp_quality(date: Column, source: Column, as_of: str) -> Column:
    """high for links and pages, medium or low for texts, rejected_future beyond the days allowed, missing for none."""
    day = F.to_date(F.lit(as_of))
    late = F.when(source == "url", date > F.date_add(day, FUTURE_DAYS["url"])).when(source == "text", date > F.date_add(day, FUTURE_DAYS["text"])).otherwise(F.lit(False))
    return (
        F.when(date.isNull(), "missing").when(late, "rejected_future").when(source.isin("url", "htmldate"), "high")
        .when((source == "text") & (F.year(date) < LOW_CONFIDENCE_BEFORE), "low").when(source == "text", "medium").otherwise("missing")
    )


def tuesday_week(day: Column) -> Column:
    """First day of a week that runs from Tuesday to Monday."""
    return F.date_add(F.to_date(F.date_trunc("week", F.date_sub(day, 1))), 1)


def sunday_week(day: Column) -> Column:
    """Last day of a week that ends on Sunday."""
    return F.next_day(F.date_sub(day, 1), "SU")


def whole_days(later: Column, earlier: Column) -> Column:
    """Whole days between two timestamps (not midnights crossed)."""
    return F.floor((F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000))
