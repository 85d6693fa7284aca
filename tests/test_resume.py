"""Profile records read from lines."""

import pytest
from pyspark.sql import functions as F

from siftwood.operators import resume


@pytest.fixture
def one(spark):
    return lambda column: spark.range(1).select(column.alias("v")).first()["v"]


def lines(*items):
    return F.array(*(F.lit(x) for x in items))


def test_line_tests(one):
    for f, good, bad in ((resume.looks_like_role, "Técnico de soporte", "me gusta leer"), (resume.looks_like_dates, "Enero 2024 - Junio 2024", "en enero"), (resume.looks_like_place, "Bogotá, Colombia", "x" * 61), (resume.looks_like_skills, "HTML CSS JavaScript SQL", "usamos python a diario"), (resume.looks_like_language, "Inglés B1", "Cocina"), (resume.looks_like_stop, "Curso de Java", "Lidera"), (resume.ends_with_connector, "trabajo con", "trabajo duro.")):
        assert one(f(F.lit(good))) and not one(f(F.lit(bad))), f.__name__


def test_parts_of_lines(one):
    assert tuple(one(resume.place_and_dates(F.lit("Soacha | Enero 2024 - Junio 2024")))) == ("Soacha", "Enero 2024", "Junio 2024") and tuple(one(resume.place_and_dates(F.lit("2020")))) == ("", "2020", "")
    assert tuple(one(resume.role_and_dates(F.lit("Desarrollador (Remoto) Enero 2024 - Mayo 2024")))) == ("Desarrollador", "Remoto", "Enero 2024", "Mayo 2024")
    assert tuple(one(resume.company_and_dates(F.lit("Acme. | Enero 2024 - Mayo 2024. Ventas")))) == ("Acme", "", "Enero 2024", "Mayo 2024", "Ventas") and tuple(one(resume.company_and_dates(F.lit("Acme | Cali")))) == ("Acme", "Cali", "", "", "")
    assert one(resume.header(F.lit("Acme — Dev")))["company"] == "Acme" and one(resume.header(F.lit("a - b"))) is None and one(resume.header(F.lit("Acme - Analista")))["role"] == "Analista"


def test_experiences_of_a_section(one):
    got = one(resume.experiences(lines("lost line", "Acme — Desarrollador", "Cali | Enero 2024 - Mayo 2024", "• Programa APIs con", "Python", "- Otra cosa", "Una linea larga mas", "", "Beta - Soporte (Remoto) Mayo 2023 - Junio 2023")))
    assert [tuple(r)[:5] for r in got] == [("Desarrollador", "Acme", "Cali", "Enero 2024", "Mayo 2024"), ("Soporte", "Beta", "Remoto", "Mayo 2023", "Junio 2023")]
    assert got[0]["bullets"] == ["Programa APIs con Python", "Otra cosa", "Una linea larga mas"] and got[1]["bullets"] == []


def test_experiences_without_a_section(one):
    got = one(resume.experiences_anywhere(lines("Nombre Apellido", "Analista de datos", "Acme | Enero 2024 - Mayo 2024. Extra", "Hizo reportes de ventas para", "la empresa", "SQL PYTHON", "Curso de cocina", "no cuenta esta linea", "Auxiliar", "Auxiliar contable", "Beta | Cali")))
    assert [(r["role"], r["company"], r["location"], r["bullets"]) for r in got] == [("Analista de datos", "Acme", "", ["Extra", "Hizo reportes de ventas para la empresa"]), ("Auxiliar contable", "Beta", "Cali", [])]


def test_clean_values(one):
    assert one(resume.without_contact(F.lit("Ana Maria Diaz | 300 123"))) == "Ana Maria Diaz" and one(resume.full_name(F.lit("Ana D."), F.lit("HV_Ana_Maria_Diaz_Ruiz"))) == "Ana Maria Diaz Ruiz" and one(resume.full_name(F.lit("Ana Diaz"), F.lit("x"))) == "Ana Diaz"
    assert one(resume.line(F.lit("  a   b "))) == "a b" and one(resume.line(F.lit("Referencias personales"))) == "" and one(resume.line(F.lit("x" * 221))) == ""
    assert one(resume.bullet(F.lit("• Hace cosas Operador de parque"))) == "Hace cosas" and one(resume.certificates(F.lit("Curso A • Curso B | Formación complementaria"))) == ["Curso A", "Curso B"]
    assert one(resume.summary(F.lit("Uno dos. Tres cuatro. " + "palabra " * 20))).startswith("Uno") and one(resume.url(F.lit("github.com/x"))) == "https://github.com/x"
    assert one(resume.better_name(F.lit("Ana D"), F.lit("Ana Maria Diaz"))) == "Ana Maria Diaz" and one(resume.better_place(F.lit(""), F.lit("Cali"))) == "Cali" and one(resume.better_email(F.lit("x"), F.lit("a @b.co"))) == "a@b.co"
    assert one(resume.inline_skills(F.lit("docker y react"))) == ["React", "Docker"]
    assert one(resume.summary_from(lines("corta", "una " * 12, "Analista", "otra " * 12), lines("Analista"))) == ("una " * 12).strip()


def test_projects(one):
    records = resume.experiences(lines("Acme — Desarrollador", "• Hizo un dashboard en https://x.co/a).", "• Mas cosas hechas", "Beta — Cocinero", "• Hizo comida rica"))
    got = one(resume.projects(lines("Tienda: https://t.co", "nada"), records))
    assert [(p["name"], p["url"], p["bullets"]) for p in got] == [("Tienda", "https://t.co", []), ("Acme", "https://x.co/a", ["Mas cosas hechas"])]
    assert len(one(resume.merged_projects(F.concat(resume.projects(lines("Tienda: https://t.co"), records), resume.projects(lines("TIENDA: https://t.co"), records))))) == 2


def test_profiles_cleaned_and_merged(spark):
    ddl = f"k int, full_name string, location string, phone string, email string, linkedin string, github string, portfolio string, professional_summary string, skills array<string>, education array<string>, certifications array<string>, languages array<string>, experiences array<{resume.RECORD}>, projects array<struct<name:string,role:string,technologies:array<string>,bullets:array<string>,url:string>>"
    e = lambda role, company, a, b, *bullets: (role, company, "", a, b, list(bullets))
    rows = [(1, "Ana Diaz", "Cali", "3  0", "a @b.co", "linkedin.com/x", "", "", "Soy yo", ["SQL", "Referencias"], ["Ingenieria", "Curso Java • Curso SQL"], [], ["Inglés B1", "Cocina"], [e("Dev", "Acme", "Mayo 2023", "Junio 2023", "uno"), e("Otro", "Beta", "", ""), e("dev", "ACME", "Enero 2023", "Agosto 2023", "dos", "UNO")], [("p", "", [], ["b"], "")])]
    df = spark.createDataFrame(rows, ddl)
    r = resume.cleaned(df, "k").first()
    assert [(x["role"], x["company"], x["start_date"], x["end_date"], x["bullets"]) for x in r["experiences"]] == [("Dev", "Acme", "Enero 2023", "Agosto 2023", ["uno", "dos"]), ("Otro", "Beta", "", "", [])]
    assert (r["education"], r["certifications"], r["languages"], r["skills"], r["email"], r["linkedin"]) == (["Ingenieria"], ["Curso Java", "Curso SQL"], ["Inglés B1"], ["SQL"], "a@b.co", "https://linkedin.com/x")
    other = spark.createDataFrame([(1, "Ana Maria Diaz", "", "", "", "", "github.com/a", "", "Soy yo misma", ["sql", "Git"], [], [], [], [], [("P", "", [], [], "")])], ddl)
    m = resume.merged(df, other, "k").first()
    assert (m["full_name"], m["location"], m["github"], m["professional_summary"], m["skills"], len(m["projects"]), len(m["experiences"])) == ("Ana Maria Diaz", "Cali", "https://github.com/a", "Soy yo misma", ["SQL", "Referencias", "Git"], 1, 3)
