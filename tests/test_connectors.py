"""Portals' cards, detail pages, walls and relational reads, on small pages."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwood import fixed_values as V
from siftwood.operators import reads
from siftwood.sources import details, html, portals, walls

# one card a portal, built of that portal's own marks
CARDS = {
    "computrabajo": '<article><h2><a href="/o/1">T</a></h2><p class="fs16 fc_base mt5">Co</p><p class="fs13 fc_aux mt15">Bogota</p><span class="it-posted">Hoy</span></article>',
    "elempleo": '<div class="result-item"><h2><a href="/co/ofertas-empleo/1">T</a></h2><span>Andes S.A.S.</span><span>Remoto, Colombia</span><p>Hoy</p></div>',
    "getonboard": '<li><h3><a href="/jobs/1">T</a></h3><b class="gb-results-list__company">Co</b><i class="gb-results-list__location">Lima</i></li>',
    "indeed": '<div class="job_seen_beacon"><h2 class="jobTitle"><a href="/rc/clk?jk=abcdef12"><span>T</span></a></h2><span class="companyName">Co</span><div class="companyLocation">Cali</div></div>',
    "linkedin": '<ul class="jobs-search__results-list"><li><a class="base-card__full-link" href="/jobs/view/1">x</a><h3>T</h3><h4>Co</h4><span class="job-search-card__location">Quito</span></li></ul>',
    "magneto": '<div class="card"><h2><a href="/m/1">T</a></h2><p class="card-company">Co</p><p class="card-location">Cali</p></div>',
    "sena": '<li class="result-item"><h3><a href="/s/1">T</a></h3><p class="empresa">Co</p><p class="ubicacion">Cali</p></li>',
    "torre": '<div data-testid="job-card"><h2><a href="/t/1">T</a></h2><p class="organization">Co</p><p class="remote">Remoto</p></div>',
}


@pytest.mark.parametrize("portal", list(CARDS))
def test_cards_by_each_portals_marks(portal):
    (card,) = html.cards_of(CARDS[portal], portals.selectors_of(portal), portals.RULES.get(portal))
    assert card["title"] == "T" and card["company"] in ("Co", "Andes S.A.S.") and card["location"] and card["href"]


def test_job_keys_are_kept_once():
    beacon = lambda inside, own="": f'<div class="job_seen_beacon" {own}><h2 class="jobTitle"><span>T</span></h2>{inside}</div>'
    page = beacon("", 'data-jk="aaaa1111"') + beacon('<a data-jk="bbbb2222" href="#">x</a>') + beacon('<a href="https://co.indeed.com/viewjob?jk=aaaa1111">x</a>') + beacon('<a href="/rc/clk?jk=cccc3333&x=1">x</a>') + beacon('<a href="/elsewhere?jk=dddd4444">x</a>') + beacon("", 'data-jk="short"')
    got = html.cards_of(page, portals.SELECTORS["indeed_selenium"], portals.RULES["indeed_selenium"])
    assert [c["href"] for c in got] == [f"https://co.indeed.com/viewjob?jk={k}" for k in ("aaaa1111", "bbbb2222", "cccc3333")]


@pytest.mark.parametrize("inside,kind", [("<span>Solicitud sencilla</span>", V.EASY_APPLY), ("<button aria-label='Apply now to Co'>x</button>", V.UNKNOWN_APPLY), ("<button>Solicitar</button>", V.EXTERNAL_APPLY), ("<a title='Apply on company website'>go</a>", V.EXTERNAL_APPLY), ("<p>apply yourself</p>", V.UNKNOWN_APPLY), ("<button>Apply here</button>", V.EXTERNAL_APPLY)])
def test_ways_to_apply(inside, kind):
    assert html.application_type_of(html.tree(f"<div>{inside}</div>")) == kind


def test_detail_panel_belongs_to_the_first_card():
    card = '<div class="base-card"><a class="base-card__full-link" href="/jobs/view/{0}?r=1">x</a><h3 class="base-search-card__title">T{0}</h3></div>'
    page = card.format(1) + card.format(1) + card.format(2) + '<div class="jobs-details"><button>Easy Apply</button><div class="description__text">All of it</div></div>'
    got = html.cards_of(page, portals.SELECTORS["linkedin_selenium"], portals.RULES["linkedin_selenium"])
    assert [(c["title"], c["description"], c["application_type"]) for c in got] == [("T1", "All of it", V.EASY_APPLY), ("T2", "", V.UNKNOWN_APPLY)]


@pytest.mark.parametrize("page,url,want", [
    ('<div class="base-card"></div><p>sign in</p>', "", ("", "")), ("<p>No results found</p>", "", ("", "")), ("<p>hello</p>", "https://x/checkpoint/1", ("checkpoint", "login")), ("<div class='my-authwall'></div>", "", ("authwall", "login")),
    ("<p>Security verification</p>", "", ("security verification", "captcha")), ("<p>Inicia sesión</p>", "", ("login requerido", "login")), ("<p>hello</p>", "", ("sin cards publicas de LinkedIn", "blocked")), ("<div class='scaffold-layout__list-container'><li>x</li></div>", "", ("", "")),
])
def test_walls(spark, page, url, want):
    got = walls.page_state(page, url)
    assert (got["reason"], got["kind"]) == want


def test_details_fill_a_listing(spark):
    ddl = "key int, title string, company string, location string, salary string, description string, requirements string, modality string, raw_posted_text string, published_at timestamp, found_at timestamp"
    now = dt.datetime(2024, 3, 10, 12)
    base = ("old", "oldco", "Cali", "", "olddesc", "", "", "", None, now)
    listings = spark.createDataFrame([(k, *base) for k in (1, 2, 3)], ddl)
    page = '<h1>New • title</h1><div class="box_company"><a>NewCo</a></div><div class="box_detail"><span class="tag base">$ 3.000.000</span><p class="fc_aux">Hace 2 días</p><div class="mbB">Great job. Requisitos: Python. SQL. Beneficios: gym</div><div class="mbB">Publicada hoy</div><span class="tag base">Remoto</span></div>'
    posting = '<script type="application/ld+json">{"@type":"JobPosting","title":"LD","hiringOrganization":{"name":"LDCo"},"datePosted":"2024-03-01"}</script>'
    got = {r["key"]: r for r in details.merged(listings, spark.createDataFrame([(1, page), (2, posting), (2, None)], "key int, html string"), "key").collect()}
    r = got[1]
    assert (r["title"], r["company"], r["salary"], r["modality"]) == ("New title", "NewCo", "$ 3.000.000", "Remoto")
    assert r["description"] == "Great job. Requisitos: Python. SQL. Beneficios: gym" and r["requirements"] == "Python\nSQL"
    assert r["published_at"] == dt.datetime(2024, 3, 8, 12) and got[2]["published_at"] == dt.datetime(2024, 3, 1)
    assert (got[2]["title"], got[2]["company"], got[2]["description"]) == ("LD", "LDCo", "olddesc")
    assert tuple(got[3][c] for c in listings.columns) == (3, *base[:6], "", *base[7:])


def test_details_of_a_portal_behind_a_login(spark):
    listings = spark.createDataFrame([(1, "d", "unknown"), (2, "d", "unknown")], "key int, description string, application_type string")
    pages = spark.createDataFrame([(1, '<div class="description__text">Long</div><button>Apply</button>', "u"), (2, "<p>captcha</p>", "u")], "key int, html string, url string")
    got = {r["key"]: tuple(r)[1:] for r in walls.with_details(listings, pages, "key").collect()}
    assert got == {1: ("Long", V.EXTERNAL_APPLY), 2: ("d", "unknown")}


def test_search_urls(spark):
    df = spark.range(1)
    url = df.select(walls.jobs_url(F.lit("data engineer"), F.lit("Bogotá"), "24h", F.array(F.lit("entry_level"), F.lit("associate")), F.array(F.lit("remote")))).first()[0]
    assert url == "https://www.linkedin.com/jobs/search/?keywords=data%20engineer&location=Bogot%C3%A1&f_TPR=r86400&f_E=2,3&f_WT=2"
    with pytest.raises(Exception, match="keyword"):
        df.select(walls.jobs_url(F.lit(" "), F.lit("x"))).collect()


def test_relational_reads(spark):
    t = lambda h: dt.datetime(2024, 1, 1, h)
    offers = spark.createDataFrame([(1, "A", t(1), t(2), False, 70.0, 5), (2, "b", None, t(9), False, 90.0, 6), (3, "a", t(5), t(1), True, 99.0, 5)], "id int, portal string, found_at timestamp, created_at timestamp, notified boolean, compatibility_score double, source_id int")
    ids = lambda df: [r["id"] for r in df.collect()]
    assert ids(reads.offers(offers)) == [2, 3, 1] and ids(reads.offers(offers, "A")) == [3, 1]
    assert ids(reads.fresh_offers(offers, F.lit(t(10)), 4)) == [2] and ids(reads.pending_offers(offers, 65)) == [2, 1] and ids(reads.pending_offers(offers, 65, source_id=5)) == [1]
    gone = spark.createDataFrame([(i, "p" if i % 2 else "Q", "r", t(i % 9), f"t{i}", "c", ["why"] if i % 3 else [], "n", "u") for i in range(1, 31)], "id int, portal string, target_role string, last_seen_at timestamp, title string, company string, discard_reasons array<string>, normalized_url string, url string")
    assert reads.discarded(gone).count() == 20 and reads.discarded(gone, limit=None).count() == 30 and reads.discarded_count(gone, "q", "R").first()["n"] == 15
    shown = reads.discarded_listing(gone, limit=2).collect()
    assert [r["id"] for r in shown] == [26, 17] and {r["n_total"] for r in shown} == {30} and shown[0]["line"] == "t26 | c | Q | r | why | n"
    assert reads.without_discarded(gone, "p").count() == 15 and reads.without_discarded(gone).count() == 0
    assert reads.by_key(gone, id=3).count() == 1 and reads.by_key(gone, normalized_url="").count() == 0
    assert reads.possible_duplicates(gone, "T1", "C", "P").count() == 1 and reads.possible_duplicates(gone, "", "c", "p").count() == 0
    blocks = spark.createDataFrame([("[]",), ('["a", "b\\"c"]',), (None,)], "v string").select(reads.json_block("v")).collect()
    assert [r[0] for r in blocks] == ["[]", '[\n  "a",\n  "b\\"c"\n]', "[]"]
