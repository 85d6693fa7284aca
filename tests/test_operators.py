import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwood import schema
from siftwood.config import Settings, recipients, truthy
from siftwood.operators import digest, merge, profile, routing, scoring, state
from siftwood.plans import cycle

T0 = dt.datetime(2024, 1, 1, 10)


def listing(seq, title="Desarrollador backend junior", url=None, **kw):
    row = dict(seq=seq, title=title, company="Acme", portal="computrabajo", location="Bogota", modality="", salary="", url=url or f"https://ex.com/j/{seq}", description="Python y SQL", requirements="", published_at=None, found_at=T0, raw_posted_text="", source_id=1, application_type="unknown")
    return row | kw


def listings(spark, *rows):
    return spark.createDataFrame([tuple(r.values()) for r in rows], schema.LISTING)


RELEVANT = [("Desarrollador backend", "", "backend_junior", True), ("Senior backend", "python", "backend_junior", False), ("Asesor comercial", "python y sql", "backend_junior", False), ("Auxiliar", "python y sql", "backend junior", True), ("Auxiliar", "python", "backend_junior", False),
    ("Practicante", "docker", "devops_trainee", True), ("Front desk", "atencion al cliente", "frontend_junior", False), ("Front desk", "react y css", "frontend_junior", True), ("Auxiliar", "react y node.js", "fullstack_junior", True), ("Auxiliar", "react", "fullstack_junior", False),
    ("Auxiliar", "hardware", "infraestructura_junior", True), ("Cualquiera", "", "otro target", True), ("Tecnico QA", "pide 5 años", "qa_junior", True)]


@pytest.mark.parametrize("title,description,target,expected", RELEVANT)
def test_relevance(spark, title, description, target, expected):
    rows = listings(spark, listing(1, title, description=description))
    by_name = scoring.with_relevance(rows, target).first()["relevance"]
    by_column = scoring.with_relevance(rows, F.lit(target)).first()["relevance"]
    assert by_name["relevant"] is expected and by_name == by_column and by_name["reasons"]


def test_reject_reasons(spark):
    rows = listings(spark, listing(1, "Lider tecnico"), listing(2, "Asesor"), listing(3, "Practicante backend", description="5 anos"))
    got = [r["relevance"]["reasons"] for r in scoring.with_relevance(rows, "backend_junior").orderBy("seq").collect()]
    assert got[0] == ["title contiene lider"] and got[1] == ["cargo administrativo/no tecnico"]
    assert got[2] == ["title indica perfil de entrada: practicante", "description menciona 5 anos pero title es practicante; penalizado, no descartado", "coincide con backend_junior: backend"]


def test_match_scores(spark):
    profile_row = spark.createDataFrame([("Python, SQL, Docker", "", "backend junior")], "skills string, summary string, target_roles string")
    rows = listings(spark, listing(1, "Backend junior", description="Python SQL docker git"), listing(2, "Arquitecto senior", description="experiencia avanzada 5 años"), listing(3, "x", description=""))
    a, b, c = scoring.with_match(rows, profile_row).orderBy("seq").collect()
    # 35 + junior 18 + capped targets (backend 25, frontend 5, fullstack 15, devops 10, support 5) + skills 6
    assert a["score"] == 100 and b["score"] < 40 and "Acepta perfil junior" in a["reasons"]
    assert c["score"] == 35 and c["reasons"] == ["Sin coincidencias claras; revisar manualmente"]


def test_routing_prefers_application_type(spark):
    rows = listings(spark, listing(1, portal="LinkedIn"), listing(2, portal="linkedin", application_type="linkedin_easy_apply"), listing(3))
    got = {r["seq"]: r["review"] for r in routing.routed(rows, "backend_junior", only_easy_apply=True).collect()}
    assert got[1]["reasons"] == [routing.NOT_EASY_APPLY] and got[1]["score"] is None and got[2] is None and got[3] is None


def empty_state(spark):
    return (
        spark.createDataFrame([], "seq long, title string, company string, portal string, location string, modality string, salary string, url string, description string, requirements string, published_at timestamp, found_at timestamp, raw_posted_text string, source_id long, application_type string, normalized_url string, url_hash string, notes string, notified boolean"),
        spark.createDataFrame([], "url_hash string, seen_count int, seq long, title string, company string, portal string, compatibility_score double, found_at timestamp, last_seen_at timestamp"),
        spark.createDataFrame([], schema.SEEN_HASH),
    )


def test_cycle_is_idempotent_and_disjoint(spark):
    now = F.lit(str(T0)).cast("timestamp")
    batch = listings(spark, listing(10), listing(11, url="https://ex.com/j/10?utm_source=z"), listing(12, "Gerente senior", url="https://ex.com/s"), listing(13, "Backend otro", company="B", url="https://ex.com/o"))
    offers, rejected, seen = empty_state(spark)
    first = cycle.run_cycle(batch, offers, rejected, seen, "backend_junior", now, settings=Settings(match_threshold=40))
    assert first.offers.count() == 2 and first.discarded.count() == 1 and first.seen.count() == 2
    assert not first.discarded.join(first.offers, "url_hash").count()
    assert first.digest.count() == 1
    stats = first.stats.first()
    assert (stats["found"], stats["accepted"], stats["discarded"]) == (4, 3, 1)
    again = listings(spark, *(listing(20 + i, r["title"], r["url"], company=r["company"]) for i, r in enumerate(batch.collect())))
    second = cycle.run_cycle(again, first.offers.withColumn("notified", F.lit(True)), first.discarded, first.seen, "backend_junior", now, settings=Settings(match_threshold=40))
    assert {r["url"] for r in second.offers.collect()} == {r["url"] for r in first.offers.collect()}
    assert second.discarded.first()["seen_count"] == 2 and second.digest.count() == 0


def test_merge_rules(spark):
    offers, _, _ = empty_state(spark)
    rows = listings(spark, listing(1, description="corto", company="", salary="10"), listing(2, url="https://ex.com/j/1", description="mas largo", company="Beta", salary="11"), listing(3, "Otro", url="https://ex.com/j/1/", description="xx"))
    got = merge.merged_offers(offers, rows).collect()
    assert len(got) == 1
    r = got[0]
    assert (r["title"], r["description"], r["company"], r["salary"], r["sightings"]) == ("Desarrollador backend junior", "mas largo", "Beta", "10", 3)


def test_natural_duplicate_with_new_url_joins_the_older(spark):
    offers, _, _ = empty_state(spark)
    old = merge.merged_offers(offers, listings(spark, listing(1))).withColumn("notified", F.lit(None).cast("boolean"))
    got = merge.merged_offers(old, listings(spark, listing(5, "DESARROLLADOR Backend Junior", url="https://ex.com/new"))).collect()
    assert [(r["url"], r["sightings"]) for r in got] == [("https://ex.com/j/1", 2)]


def test_cascade_keeps_other_rows(spark):
    offers = spark.createDataFrame([("a", "x"), ("b", "y")], "url_hash string, portal string")
    logs = spark.createDataFrame([("a",), ("b",), ("a",)], "url_hash string")
    out = merge.cascade(offers, F.col("portal") == "x", logs=logs)
    assert out["offers"].count() == 1 and [r[0] for r in out["logs"].collect()] == ["b"]


def sources(spark, *rows):
    return spark.createDataFrame([(i, True, 15, 0, *r) for i, r in enumerate(rows)], "id long, enabled boolean, interval_minutes int, failure_count int, last_checked_at timestamp, paused_until timestamp").withColumns({c: F.lit(None).cast(t) for c, t in (("last_error", "string"), ("last_failed_at", "timestamp"))})


def test_due_and_paused(spark):
    now = F.lit(str(T0)).cast("timestamp")
    rows = sources(spark, (T0 - dt.timedelta(minutes=20), None), (None, None), (T0 - dt.timedelta(minutes=5), None), (None, T0 + dt.timedelta(hours=1)), (T0 - dt.timedelta(minutes=15), None))
    assert sorted(r["id"] for r in state.due(rows, now).collect()) == [0, 1, 4]
    assert sorted((r["id"], r["skipped"]) for r in state.selected(rows, now).collect()) == [(0, False), (1, False), (3, True), (4, False)]


def test_third_block_pauses_and_success_resets(spark):
    rows, me = sources(spark, (None, None)), F.lit(True)
    for h in (10, 11, 12):
        rows = state.blocked(rows, me, F.lit(f"2024-01-01 {h}:00:00").cast("timestamp"), F.lit("403"))
    r = rows.first()
    assert r["failure_count"] == 3 and r["paused_until"] == dt.datetime(2024, 1, 2, 12)
    assert not state.disabled_when_blocked(rows).first()["enabled"]
    assert state.checked(rows, me, F.lit(str(T0)).cast("timestamp"), F.lit("oops")).first()["failure_count"] == 3
    ok = state.checked(rows, me, F.lit(str(T0)).cast("timestamp")).first()
    assert ok["failure_count"] == 0 and ok["paused_until"] is None
    with pytest.raises(Exception, match="below minimum"):
        state.with_intervals(rows, me, 5).collect()


def offers_table(spark, scores):
    rows = [(f"h{i}", f"T{i}", s, T0, None, None, "", f"u{i}", "unknown", "c", "p", "", "", ["a", "b"]) for i, s in enumerate(scores)]
    return spark.createDataFrame(rows, "url_hash string, title string, compatibility_score double, found_at timestamp, created_at timestamp, published_at timestamp, raw_posted_text string, url string, application_type string, company string, portal string, location string, modality string, match_reason array<string>")


def test_top_k_with_overflow(spark):
    got = digest.top_rows(offers_table(spark, [90.0, 80.0, 70.0]), 2, digest.rank_order()).orderBy("position").collect()
    assert [(r["url_hash"], r["overflow"]) for r in got] == [("h0", 1), ("h1", 1)]
    assert digest.top_rows(offers_table(spark, [90.0, 80.0]), 0, digest.rank_order()).count() == 2


def test_digest_parts_hold_all_entries_once(spark):
    out = digest.digest(offers_table(spark, [90.0, 80.0, 70.0, 66.0, 65.0]), Settings(digest_max_chars=450)).orderBy("part").collect()
    assert len(out) >= 2 and "Parte 1/" in out[0]["message"] and [k for r in out for k in r["keys"]] == ["h0", "h1", "h2", "h3", "h4"]
    one = digest.digest(offers_table(spark, [90.0, 80.0, 70.0]), Settings(digest_max_rows=2)).collect()
    assert len(one) == 1 and "Hay 1 ofertas adicionales" in one[0]["message"] and "Parte" not in one[0]["message"]


@pytest.mark.parametrize("sizes,limit,expected", [([4, 3, 6, 1], 10, [[0, 1], [2, 3]]), ([600], 500, [[0]]), ([], 500, [])])
def test_packing(spark, sizes, limit, expected):
    items = [str(i) * n for i, n in enumerate(sizes)]
    df = spark.createDataFrame([(items,)], "x array<string>")
    got = df.select(digest.packed(F.col("x"), F.lit(""), F.lit(""), limit, floor=1)).first()[0]
    assert got == [[items[i] for i in part] for part in expected]


def test_outbox_and_partial_delivery(spark):
    tried = spark.createDataFrame([("a",), ("b",)], "id string")
    assert sorted(tuple(r) for r in digest.outbox(tried, tried.where("id = 'a'"), "id").select("id", "status").collect()) == [("a", "sent"), ("b", "pending")]
    assert {r["status"] for r in digest.outbox(tried, tried.where("false"), "id").collect()} == {"error"}


def greedy(lines):
    def sig(s):
        import re

        from siftwood.fixed_values import TOKEN_STOPWORDS

        return {t for t in re.findall(r"[a-z0-9#+]+", s.lower()) if t not in TOKEN_STOPWORDS and len(t) >= 3}

    kept = []
    for x in lines:
        s = sig(x)
        if s and not any((o := len(s & k)) and ((o >= min(len(s), len(k)) >= 4) or (o >= 4 and o / max(len(s), len(k)) >= 0.75)) for _, k in kept):
            kept.append((x, s))
    return [x for x, _ in kept]


def test_near_duplicate_bullets_equal_a_loop(spark):
    lines = ["alpha beta gamma delta epsilon", "alpha beta gamma delta", "one two three", "one two three", "alpha beta gamma delta omega", "", "x", "four five six seven eight", "six seven eight four five nine"]
    df = spark.createDataFrame([(lines,)], "x array<string>")
    assert df.select(profile.distinct_bullets("x")).first()[0] == greedy(lines)


def test_profile_parsing(spark):
    raw = "Ana Ejemplo\nBogota | Colombia\nana @ ejemplo.com +57 300 123 4567 github.com/ana\n\nPERFIL\nDesarrolla servicios\nweb con Python\n\nHABILIDADES\n• Python, SQL; Git\n\nEDUCACION\nTecnologia en sistemas\nIDIOMAS:\nIngles B1\n\n\n\n"
    r = profile.parsed(spark.createDataFrame([(1, raw)], "id int, raw string"), "id", "raw").first()
    assert r["full_name"] == "Ana Ejemplo" and r["location"] == "Bogota" and r["email"] == "ana@ejemplo.com"
    assert r["professional_summary"] == "Desarrolla servicios web con Python" and r["skills"] == ["Python", "SQL", "Git"]
    assert r["education"] == ["Tecnologia en sistemas"] and r["languages"] == ["Ingles B1"] and r["github"] == "https://github.com/ana" and r["technologies"] == ["SQL", "Python", "Git", "GitHub"]


def test_experiences_merge_and_rank(spark):
    rows = spark.createDataFrame([(1, 1, "Dev", "Acme", "", "Marzo 2020", "Enero 2021", ["a"]), (1, 2, "dev", "ACME", "Cali", "Enero 2020", "Junio 2021", ["A", "b"]), (1, 3, "Soporte", "Beta", "", "", "", ["python"])], "doc int, seq int, role string, company string, location string, start_date string, end_date string, bullets array<string>")
    got = {r["company"]: r for r in profile.merged_experiences(rows, "doc").collect()}
    assert (got["Acme"]["start_date"], got["Acme"]["end_date"], got["Acme"]["bullets"], got["Acme"]["location"]) == ("Enero 2020", "Junio 2021", ["a", "b"], "Cali")
    ranked = profile.ranked_experiences(rows, "doc", ["python"], [], {"acme|dev": 0}).orderBy("position").collect()
    assert [(r["company"], r["position"]) for r in ranked][1] == ("Beta", 2) and len(ranked) == 2


def test_settings_values():
    assert recipients("1, 2,", None) == ["1", "2"] and recipients("", " 7 ") == ["7"] and recipients(None) == []
    assert truthy("Yes") and not truthy("0") and not truthy(None)
