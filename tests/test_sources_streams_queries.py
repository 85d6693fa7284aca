import datetime as dt
import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from siftwood import catalogue
from siftwood.sources import documents, html, portals, sinks
from siftwood.streaming import machine

PAGE = '<ul><article class="job"><h2><a href="/x/1?utm_source=t">Title &amp; co</a></h2><div class="company">Co</div><div class="location">Remoto</div><time>Hoy</time></article><article><h2></h2></article></ul>'


@pytest.mark.parametrize("portal", [p for p in portals.supported() if p in ("elempleo", "getonboard", "computrabajo", "magneto", "torre", "sena")])
def test_cards_of_portals(spark, portal):
    pages = spark.createDataFrame([(portal, 1, "https://ex.com/list", PAGE), ("nobody", 2, "https://ex.com/", PAGE)], "portal string, source_id long, url string, html string")
    cards = html.with_cards(pages, portals.SELECTORS)
    got = html.scanned(cards, F.lit("2024-01-01 10:00:00").cast("timestamp"), 25).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title"], r["company"], r["listing_url"], r["modality"], r["published_at"]) == ("Title & co", "Co", "https://ex.com/x/1", "Remoto", dt.datetime(2024, 1, 1, 10))


def test_portals_are_rows_and_unknown_ones_errors(spark):
    assert portals.as_table(spark).where("portal = 'indeed' and field = 'card' and pos = 0").first()["selector"] == "div.job_seen_beacon"
    assert portals.supported() == sorted(portals.SELECTORS)
    with pytest.raises(ValueError):
        portals.selectors_of("nobody")


@pytest.mark.parametrize("page,status,cards,expected", [("x", 403, False, "status 403"), ("x", 429, False, "status 429"), ('<div class="g-recaptcha">', 200, False, "widget recaptcha visible"), ('<div class="g-recaptcha">', 200, True, None), ("<p>Verify you are HUMAN</p>", 200, True, "texto visible de captcha"), ("<b>login required</b>", 200, False, "login requerido detectado en el contenido"), ("<p>ok</p>", 200, False, None), (None, 200, False, None)])
def test_block_reasons(spark, page, status, cards, expected):
    df = spark.createDataFrame([(page,)], "h string")
    assert df.select(html.block_reason("h", F.lit(status), F.lit(cards))).first()[0] == expected


def test_json_ld_details(spark):
    body = '{"@graph":[{"@type":"Org"},{"@type":"JobPosting","title":"Dev","hiringOrganization":{"name":"Co"},"jobLocation":{"address":{"addressLocality":"Cali","addressRegion":"CALI","addressCountry":"CO"}},"baseSalary":{"currency":"COP","value":{"value":5}},"description":"&lt;p&gt;Hola&lt;/p&gt;"}]}'
    detail = spark.createDataFrame([("k", f'<script type="application/ld+json">{body}</script>')], "key string, html string")
    base = spark.createDataFrame([("k", "old", "", "", "", ""), ("z", "keep", "", "", "", "")], "key string, title string, company string, location string, salary string, description string")
    got = {r["key"]: r for r in html.with_details(base, detail, "key").collect()}
    assert tuple(got["k"])[1:] == ("Dev", "Co", "Cali, CO", "COP 5", "Hola") and got["z"]["title"] == "keep"


def test_selectors_agree_with_native_cards(spark, sf):
    native = catalogue.QUERIES["html_cards"](spark, sf).where("label <> ''").select("page_id", "label", "href")
    parsed = catalogue.QUERIES["html_selectors"](spark, sf).select("page_id", F.col("title").alias("label"), "href")
    assert native.exceptAll(parsed).count() == 0 and parsed.exceptAll(native).count() == 0 and parsed.count() > 0


def test_listing_texts_and_profile_files(spark, tmp_path):
    r = spark.createDataFrame([("Dev\nEmpresa: Co\nUbicación: Cali\nver https://ex.com/1 ya",)], "x string").select(documents.listing_of("x").alias("l")).first()["l"]
    assert (r["title"], r["company"], r["location"], r["url"]) == ("Dev", "Co", "Cali", "https://ex.com/1")
    path = tmp_path / "cv_ana_ejemplo.docx"
    path.write_bytes(sinks.docx(["Ana Ejemplo", "Línea & más"]))
    rows = documents.profile_texts(spark, str(tmp_path)).collect()
    assert rows[0]["raw"] == "Ana Ejemplo\nLínea & más"
    files = spark.createDataFrame([("/a/cv_ana_perez_ejemplo.pdf",), ("/a/other.pdf",)], "path string")
    assert documents.related_files(files, F.lit("Perez Ejemplo")).count() == 1
    assert documents.mail_alerts(spark).count() == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("p", "t", "u", "", 1.0, '["a","b"]', dt.datetime(2024, 1, 1))], "portal string, title string, url string, normalized_url string, compatibility_score double, discard_reasons string, found_at timestamp")
    assert sinks.export(rows, str(tmp_path / "o.csv")) == 1
    back = spark.read.option("header", True).csv(str(tmp_path / "o.csv")).first()
    assert back["discard_reasons"] == "a; b" and back["found_at"] == "2024-01-01T00:00:00+00:00" and back["url"] == "u"
    with pytest.raises(ValueError):
        sinks.export(rows, str(tmp_path / "o.xml"))


def test_failure_machine_skips_paused_events(spark):
    hour = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    rows = [("s", hour(h), "blocked") for h in (0, 1, 2, 3)] + [("s", hour(30), "blocked"), ("s", hour(60), "ok"), ("t", hour(0), "error")]
    df = spark.createDataFrame(rows, "source string, at timestamp, outcome string")
    got = sorted((r["source"], r["at"], r["skipped"], r["failure_count"], r["paused_until"]) for r in machine.simulate_failures(df).where("source = 's'").collect())
    assert [g[2:4] for g in got] == [(False, 1), (False, 2), (False, 3), (True, 3), (False, 4), (False, 0)]
    assert got[4][4] == hour(54) and got[5][4] is None


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_every_query_runs(spark, sf, name):
    assert catalogue.QUERIES[name](spark, sf).count() > 0


def test_queries_equal_their_sql(spark, sf, tmp_path):
    for name in catalogue.SQL:
        catalogue.QUERIES[name](spark, sf).write.parquet(str(tmp_path / name))
    script = os.path.join(os.path.dirname(__file__), "compare_sql.py")
    done = subprocess.run([sys.executable, script, sf, str(tmp_path)], capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stdout + done.stderr


def test_flagship(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and df.columns == ["source", "position", "doc_id", "title", "score", "reasons"]
