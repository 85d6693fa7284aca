import datetime as dt
import unicodedata
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from siftwood.functions import dates, text, urls

NOW = dt.datetime(2024, 3, 1, 12, 0, 0)


def values(spark, rows, expr, ddl="x string"):
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, " + ddl)
    return [r[0] for r in df.orderBy("i").select(expr).collect()]


def plain(s):
    n = unicodedata.normalize("NFKD", " ".join((s or "").split()).casefold())
    return "".join(c for c in n if not unicodedata.combining(c))


def test_norm_key_agrees_with_unicode_normalisation(spark):
    rows = ["  Ánálisis \t de  DATOS\n", "STRASSE ß", "Çédille ÑANDÚ", "", None, "Łódź".replace("Ł", "L"), "c# .NET"]
    assert values(spark, rows, text.norm_key("x")) == [plain(r) for r in rows]


@pytest.mark.parametrize("term,inside,outside", [("c#", "uso de c# diario", "abc#1x".replace("1", "")), (".net", "en .net core", "x1.net2"), ("3+ anos", "pide 3+ anos", "13+ anos1"), ("it", "area it", "digital")])
def test_terms_have_borders(spark, term, inside, outside):
    assert values(spark, [inside, outside], text.has_term("x", term)) == [True, False]


def test_keep_first_and_picks(spark):
    assert values(spark, [["b", "a", "B ", "", "A"]], text.keep_first_ci("x"), "x array<string>") == [["b", "a"]]
    assert values(spark, [("aa", "bb"), ("a", "bb"), (None, None)], text.pick_longer("x", "y"), "x string, y string") == ["aa", "bb", ""]
    assert values(spark, [("unknown", "easy"), ("ext", "easy"), ("", None)], text.pick_known("x", "y"), "x string, y string") == ["easy", "ext", "unknown"]
    assert values(spark, [("a", "b"), ("a\nb", "b"), ("", "b"), (None, "")], text.append_line("x", "y"), "x string, y string") == ["a\nb", "a\nb", "b", ""]


def test_json_lists_are_tolerant(spark):
    assert values(spark, ['["a","b"]', '"a"', "a", "", None, "[a"], text.json_list("x")) == [["a", "b"], ["a"], ["a"], [], [], ["[a"]]


def test_mojibake_slug_sentence(spark):
    assert values(spark, ["Lógica".encode().decode("latin-1"), "bien €", "Ã"], text.repair_mojibake("x")) == ["Lógica", "bien €", "Ã"]
    assert values(spark, ["Dev  Ops/2", "", "¿?"], text.slug("x")) == ["dev-ops-2", "cv", "cv"]
    assert values(spark, ["hola", "hola..", " "], text.sentence("x")) == ["hola.", "hola.", ""]


def test_pretty_and_words(spark):
    assert values(spark, ["node.js", "docker", "ci/cd"], text.pretty("x", {"node.js": "Node.js"})) == ["Node.js", "Docker", "Ci/Cd"]
    assert values(spark, ["uno dos tres con y de"], text.cap_words("x", 5, ("y", "con", "de"))) == ["uno dos tres"]


CANONICAL = [
    ("HTTPS://Ex.com/a/?utm_source=x&b=&a=1#f", "https://Ex.com/a?b=&a=1"),
    ("http://ex.com?ref=1", "http://ex.com/"),
    ("http://ex.com/p//?q=a%20b&REF=2&x=%C3%B1", "http://ex.com/p?q=a+b&x=%C3%B1"),
    ("http://ex.com/", "http://ex.com/"),
    ("http://ex.com/a?x=1&x=2&currentJobId=9", "http://ex.com/a?x=1&x=2"),
    ("", "/"),
]


def test_canonical_urls(spark):
    assert values(spark, [a for a, _ in CANONICAL], urls.canonical_url("x")) == [b for _, b in CANONICAL]


def test_canonical_urls_are_fixed_points(spark):
    once = [b for _, b in CANONICAL]
    assert values(spark, once, urls.canonical_url("x")) == once


def test_absolute_urls(spark):
    base, rel = "https://ex.com/jobs/list?page=2", ["/a", "b", "//cdn.ex.com/c", "https://o.com/d", "?p=3", "#top"]
    assert values(spark, rel, urls.absolute_url(F.lit(base), "x")) == [urljoin(base, r) for r in rel]


def test_listing_ids_and_codes(spark):
    rows = ["https://co.indeed.com/viewjob?jk=abcdef1234&x=1", "https://evil.com/viewjob?jk=abcdef1234", "https://indeed.com/viewjob?jk=a-b"]
    assert values(spark, rows, urls.listing_id("x", "indeed.com")) == ["abcdef1234", "", ""]
    assert values(spark, [["Remote", "on-site", "remote"]], urls.filter_codes("x", {"remote": "2", "on-site": "1"}, "place"), "x array<string>") == [["2", "1"]]
    with pytest.raises(Exception, match="unknown place"):
        values(spark, [["moon"]], urls.filter_codes("x", {"remote": "2"}, "place"), "x array<string>")
    assert values(spark, ["a b"], urls.search_url("http://x", q="x", r=F.lit(""))) == ["http://x?q=a%20b"]


@pytest.mark.parametrize("said,delta", [("hace 3 horas", dt.timedelta(hours=3)), ("Hace 2 días", dt.timedelta(days=2)), ("ayer", dt.timedelta(days=1)), ("Publicada hoy", dt.timedelta(0)), ("ago 5 minutes", dt.timedelta(minutes=5)), ("renewed", dt.timedelta(0)), ("3 hours ago", None), ("", None)])
def test_relative_dates(spark, said, delta):
    got = values(spark, [said], dates.relative_posted("x", F.lit(str(NOW)).cast("timestamp")))
    assert got == [NOW - delta if delta is not None else None]


def test_absolute_dates(spark):
    rows = ["publicado 05/02/2024", "2024-02-05 10:30", "5 de febrero de 2024", "31/31/2024", "pronto"]
    day = dt.datetime(2024, 2, 5)
    assert values(spark, rows, dates.absolute_posted("x")) == [day, day.replace(hour=10, minute=30), day, None, None]


def test_local_time_and_fallback_zone(spark):
    at = F.lit("2024-01-02 14:30:00").cast("timestamp")
    assert values(spark, ["a"], dates.local_text(at, "America/Bogota")) == ["2024-01-02 09:30"]
    assert dates.known_zone("Mars/Base") == "UTC" and dates.known_zone("") == "America/Bogota"
    assert values(spark, ["a"], dates.local_text(F.lit("2024-01-02 05:00:00").cast("timestamp"), "America/Bogota")) == ["2024-01-02"]


def test_freshness(spark):
    now = F.lit(str(NOW)).cast("timestamp")
    rows = [None, NOW - dt.timedelta(hours=24), NOW - dt.timedelta(days=3)]
    assert values(spark, rows, dates.is_fresh("x", now), "x timestamp") == [True, True, False]


def test_month_year(spark):
    assert [tuple(r) if r else None for r in values(spark, ["Marzo 2021", "2021", "actual"], dates.month_year("x"))] == [(2021, 3), None, None]
