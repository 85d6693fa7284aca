"""Documents of profiles for a target."""

import pytest
from pyspark.sql import functions as F

from siftwood.operators import resume
from siftwood.operators import resume_builder as build
from siftwood.sources import documents as files

DDL = f"k int, full_name string, location string, phone string, email string, linkedin string, github string, portfolio string, professional_summary string, raw_text string, skills array<string>, education array<string>, certifications array<string>, languages array<string>, experiences array<{resume.RECORD}>, projects array<struct<name:string,role:string,technologies:array<string>,bullets:array<string>,url:string>>"


@pytest.fixture
def profiles(spark):
    jobs = [("Cocinero", "Fonda", "", "", "", ["Cocina platos tipicos con mucho cuidado"]), ("Auxiliar de oficina", "Acme", "Cali", "Enero 2023", "Mayo 2023", ["Atiende incidencias de usuarios en centros de computo. Escribe reportes de inventario."]), ("Operador", "Parque", "", "", "", [])]
    works = [("Tienda", "Dev", ["React"], ["Desarrolla un dashboard con React y Next.js"], "https://t.co/x"), ("Acme", "", [], [], "")]
    return spark.createDataFrame([(1, "Ana Diaz", "Cali", "300", "a@b.co", "", "https://github.com/a", "", "Hago soporte tecnico", "registro de inventarios; git y sql", ["Git", "SQL"], ["Tecnologia en software", "Referencias: nadie"], ["Curso de Python"], ["Inglés B1", "de"], jobs, works)], DDL)


def test_targets():
    assert len(build.targets()) == 8 and set(build.TARGET_SECTIONS) == set(build.TARGET_SUMMARIES) == set(build.targets())
    with pytest.raises(ValueError):
        build.known("astronaut")


def test_documents(profiles, tmp_path):
    r = build.with_files(build.documents(profiles, "soporte_aplicaciones", F.lit("Soporte SQL"), F.lit("Analista"))).first()
    sections = {s["category"]: s["skills"] for s in r["sections"]}
    assert sections["Bases de datos"] == ["SQL"] and "Soporte técnico" in sections["Soporte y aplicaciones"] and set(sections["Herramientas"]) == {"Git"} and "Reportes" in sections["Soporte y aplicaciones"]
    lines = [(b["style"], b["text"]) for b in r["blocks"]]
    assert lines[:2] == [("title", "Ana Diaz"), ("paragraph", "Cali | 300 | a@b.co | https://github.com/a")]
    texts = [t for _, t in lines]
    assert texts.index("Auxiliar de oficina - Acme | Cali | Enero 2023 - Mayo 2023") < texts.index("Cocinero - Fonda") and not any("Operador" in t for t in texts)
    assert "Tienda - Dev (React)" in texts and "https://t.co/x" in texts and not any(t.startswith("Acme") for t in texts)
    assert ("bullet", "Tecnología en software") in lines and not any("Referencias" in t for t in texts) and ("bullet", "Inglés B1") in lines and ("bullet", "de") not in lines
    assert r["file_name"] == "CV_ATS_Ana_Diaz_soporte_aplicaciones.docx" and "Adaptado para una vacante de Analista." in r["summary"]
    path = tmp_path / "x.docx"
    path.write_bytes(r["content"])
    assert all(t in files.docx_text(path.read_bytes()) for t in texts)


def test_empty_profile(spark, profiles):
    one = profiles.select(*(F.lit(None).cast(t).alias(c) if not t.startswith("array") else F.expr(f"cast(array() as {t})").alias(c) for c, t in profiles.dtypes))
    r = build.documents(one, "backend_junior").first()
    assert [b["text"] for b in r["blocks"]][0] == "CV ATS" and r["sections"] == []


def test_texts(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first()["v"]
    assert one(build.polished(F.lit("Tecnico en linea de comandos y  gestion"))) == "Técnico en línea de comandos y gestión"
    assert one(build.distinct_skills(F.array(*map(F.lit, ["SQL", "sql.", "web", "r", "C#", "ab", "Node.js"])))) == ["SQL", "C#", "Node.js"]
    assert one(build.known_technologies(F.array(F.lit("postgres 15"), F.lit("r"), F.lit("react"), F.lit("React")))) == ["PostgreSQL", "React"]
    assert one(build.letter_summary(F.lit("Yo."), F.lit("X"), F.array(F.lit("why")))) == "Yo. Perfil orientado a la vacante de X. Coincidencia principal: why."
    assert one(build.application_message(F.lit("X"), F.lit("puesto QA y backend"), F.lit("Ana"), F.lit("Ing."), F.lit("SQL"), F.lit(""))) == "Hola, me interesa la vacante de X. Soy Ana, Ing., con conocimientos en SQL. " + build.ROLE_SENTENCES["qa"]
    assert one(build.with_support_sentences(F.array(F.lit("abc")), F.lit("Técnico en soporte"), F.lit("recursos tecnológicos"), "cloud_support"))[1].startswith("Gestión y organización")


def test_sections_of_a_target_make_a_small_plan(spark, sf):
    """What a profile shows is worked out once, not once for each skill of the target's table."""
    from siftwood import catalogue

    found = catalogue.QUERIES["resume_sections"](spark, sf)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 50_000 and plan.count("regexp_replace") < 150
