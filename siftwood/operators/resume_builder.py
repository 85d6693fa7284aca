"""Profiles to documents for one target: skills by section, summaries, ordered experiences, and the document's paragraphs as rows.

What a target wants is data: sections list skills, each with the technologies or signals any of which a profile must show.
"""

from __future__ import annotations

import functools
import io
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import Text, col, contains_any, let, norm_key, repair_mojibake, safe_name, sentence, text
from ..shipping import ship_package
from .profile import NONE, distinct_bullets, ideas, trimmed_bullet
from .scoring import offer_keywords, technologies

# Ranking words of each target.
TARGET_KEYWORDS = {
    "devops_trainee": ("git", "github", "línea de comandos", "despliegue", "cloud", "automatización", "documentación", "scripts", "postgresql"),
    "soporte_aplicaciones": ("soporte", "usuarios", "incidencias", "diagnóstico", "documentación", "inventario", "reportes", "aplicaciones web", "sql"),
    "infraestructura_junior": ("soporte", "mantenimiento", "inventario", "equipos", "diagnóstico", "configuración", "incidencias", "línea de comandos"),
    "cloud_support": ("cloud", "despliegue", "monitoreo", "logs", "soporte", "documentación", "postgresql"),
    "qa_junior": ("documentación", "reportes", "validación", "incidencias", "aplicaciones web", "sql"),
    "backend_junior": ("backend", "python", "java", "node.js", "express", "apis", "sql", "postgresql", "mysql", "git"),
    "frontend_junior": ("frontend", "react", "next.js", "javascript", "typescript", "interfaces", "responsive", "vercel", "git"),
    "fullstack_junior": ("fullstack", "react", "next.js", "javascript", "typescript", "node.js", "postgresql", "mysql", "git", "despliegue"),
}
# Opening sentences of each target.
TARGET_SUMMARIES = {
    "devops_trainee": "Tecnólogo en Desarrollo de Software con conocimientos en desarrollo web, bases de datos, Git, línea de comandos, despliegue de aplicaciones y soporte técnico. Experiencia práctica en proyectos con React, Next.js, PostgreSQL, Vercel y Neon, con interés en crecer en DevOps, automatización, infraestructura cloud y CI/CD.",
    "soporte_aplicaciones": "Tecnólogo en Desarrollo de Software con experiencia práctica en soporte técnico, desarrollo web, bases de datos y documentación. Con capacidad para diagnosticar incidencias, apoyar usuarios, revisar aplicaciones, generar reportes y colaborar en la mejora de procesos tecnológicos.",
    "infraestructura_junior": "Tecnólogo en Desarrollo de Software con experiencia en soporte operativo, trabajo con centros de cómputo, inventarios tecnológicos y mantenimiento básico de equipos. Interesado en crecer en infraestructura TI, administración de sistemas y automatización.",
    "cloud_support": "Tecnólogo en Desarrollo de Software con experiencia práctica en despliegue de aplicaciones, bases de datos, control de versiones y soporte técnico. Interesado en fortalecer su perfil en operación cloud, monitoreo, continuidad de servicios y administración de entornos.",
    "qa_junior": "Tecnólogo en Desarrollo de Software con experiencia en desarrollo web, documentación y seguimiento de procesos. Interesado en aportar en validación funcional, reporte de hallazgos, calidad de software y mejora continua.",
    "backend_junior": "Tecnólogo en Desarrollo de Software con experiencia práctica en desarrollo de aplicaciones, bases de datos y lógica de negocio. Con conocimientos en Python, Java, SQL y construcción de soluciones web orientadas al backend.",
    "frontend_junior": "Tecnólogo en Desarrollo de Software con experiencia práctica en desarrollo frontend, construcción de interfaces, consumo de APIs y despliegue de proyectos web. Ha trabajado con React, Next.js, JavaScript, TypeScript y diseño responsivo en proyectos reales.",
    "fullstack_junior": "Tecnólogo en Desarrollo de Software con experiencia práctica en desarrollo web full stack, interfaces modernas, bases de datos y despliegue de aplicaciones. Ha trabajado con React, Next.js, JavaScript, TypeScript, PostgreSQL, Vercel y Neon en proyectos reales.",
}
# What a profile's text shows, by the words that say so.
SIGNALS = {
    "support": ("soporte tecnico", "soporte administrativo", "soporte basico"),
    "support_users": ("usuarios", "uso de herramientas informaticas", "uso de equipos"),
    "diagnosis": ("diagnostico", "fallos", "incidencias", "problemas"),
    "documentation": ("documentacion", "hojas de vida detalladas"),
    "reports": ("reportes", "reporte", "planillas"),
    "inventory": ("inventario", "inventarios", "recursos tecnologicos"),
    "maintenance": ("mantenimiento preventivo", "mantenimiento correctivo", "hardware", "software", "historial de mantenimiento"),
    "equipment_config": ("configuracion", "equipos de computo", "actualizaciones"),
    "networking": ("conectividad", "laboratorios", "centros de computo"),
    "command_line": ("linea de comandos", "terminal", "pip"),
    "deployment": ("despliegue", "vercel", "neon"),
    "cloud": ("cloud", "aws", "azure"),
    "automation": ("automatizacion", "apagado de equipos", "scripts"),
    "problem_solving": ("resolucion de problemas", "pensamiento analitico", "diagnostico"),
    "web_apps": ("aplicaciones web", "plataforma web", "e-commerce", "dashboards", "panel administrativo"),
    "env_vars": ("variables de entorno",),
    "commerce": ("e-commerce",),
    "mobile": ("movil",),
    "responsive": ("responsive", "responsivo"),
}
# Roles that speak for support and networking, and technologies that together speak for cloud and settings.
SUPPORT_ROLES = ("auxiliar de oficina", "tecnico en soporte", "soporte", "centros de computo")
SIGNALS_OF_SUPPORT_ROLES, SIGNALS_OF_HOSTING, HOSTING = ("support", "networking"), ("cloud", "env_vars"), ("Vercel", "Neon")
_SQL = ("Bases de datos", (("SQL", ("SQL",)), ("PostgreSQL", ("PostgreSQL",)), ("MySQL", ("MySQL",))))
_GIT = (("Git", ("Git",)), ("GitHub", ("GitHub",)))
_HOSTS = (("Vercel", ("Vercel",)), ("Neon", ("Neon",)))
_SCRIPTS = (("JavaScript", ("JavaScript",)), ("TypeScript", ("TypeScript",)))
_REACT = (("React", ("React",)), ("Next.js", ("Next.js",)))
_DOCUMENTED, _SHELL, _DEPLOYED = ("Documentación técnica", ("documentation",)), ("Línea de comandos", ("command_line",)), ("Despliegue de aplicaciones", ("deployment",))
# Sections of each target; a skill is listed if any of its technologies or signals is there.
TARGET_SECTIONS = {
    "devops_trainee": (
        ("DevOps básico", (*_GIT, _SHELL, _DEPLOYED, ("Variables de entorno", ("env_vars",)))),
        ("Cloud y despliegue", (*_HOSTS, ("Fundamentos de cloud", ("cloud",)))),
        _SQL,
        ("Desarrollo", (*_SCRIPTS, *_REACT, ("Python", ("Python",)))),
        ("Automatización", (("Scripts", ("automation", "Python")), _DOCUMENTED, ("Resolución de problemas", ("problem_solving",)))),
    ),
    "infraestructura_junior": (
        ("Soporte e infraestructura", (("Soporte técnico", ("support",)), ("Soporte a usuarios", ("support_users",)), ("Mantenimiento preventivo/correctivo", ("maintenance",)), ("Inventario tecnológico", ("inventory",)))),
        ("Sistemas y operación", (_SHELL, ("Configuración de equipos", ("equipment_config",)), ("Diagnóstico de fallos", ("diagnosis",)))),
        ("Redes básicas", (("Conectividad", ("networking",)), ("Configuración básica", ("equipment_config", "networking")), ("Resolución de incidencias", ("diagnosis", "support")))),
        ("Herramientas", (*_GIT, _DOCUMENTED)),
    ),
    "soporte_aplicaciones": (
        ("Soporte y aplicaciones", (("Soporte técnico", ("support",)), ("Soporte a usuarios", ("support_users",)), ("Diagnóstico de incidencias", ("diagnosis",)), _DOCUMENTED, ("Reportes", ("reports",)), ("Inventario tecnológico", ("inventory",)), ("Mantenimiento de equipos", ("maintenance",)))),
        _SQL,
        ("Desarrollo web", (("JavaScript", ("JavaScript",)), *_REACT, ("TypeScript", ("TypeScript",)), ("Aplicaciones web", ("web_apps",)))),
        ("Herramientas", (*_GIT, *_HOSTS)),
        ("Sistemas y operación", (_SHELL, _DEPLOYED)),
    ),
    "cloud_support": (
        ("Soporte y continuidad", (("Soporte técnico", ("support",)), _DOCUMENTED, ("Reportes", ("reports",)), ("Resolución de incidencias", ("diagnosis",)))),
        ("Cloud y despliegue", (*_HOSTS, ("Fundamentos de cloud", ("cloud",)), ("Monitoreo", ("reports", "documentation")), ("Logs", ("deployment",)))),
        _SQL,
        ("Herramientas", (*_GIT, ("Linux", ("Linux", "command_line")), _SHELL)),
    ),
    "qa_junior": (
        ("Calidad y soporte", (_DOCUMENTED, ("Reportes", ("reports",)), ("Validación funcional", ("web_apps",)), ("Diagnóstico de incidencias", ("diagnosis",)))),
        _SQL,
        ("Desarrollo web", (("JavaScript", ("JavaScript",)), *_REACT, ("Aplicaciones web", ("web_apps",)))),
        ("Herramientas", (*_GIT, _SHELL)),
    ),
    "backend_junior": (
        ("Desarrollo backend", (("Python", ("Python",)), ("Java", ("Java",)), ("Node.js", ("Node.js",)), ("Express", ("Express",)), ("APIs REST", ("web_apps",)))),
        _SQL,
        ("Herramientas", (*_GIT, *_HOSTS)),
        ("Operación y despliegue", (_SHELL, _DEPLOYED, _DOCUMENTED)),
    ),
    "frontend_junior": (
        ("Frontend y UI", (*_REACT, *_SCRIPTS, ("Interfaces", ("web_apps",)), ("Diseño responsivo", ("responsive",)))),
        ("Integración web", (("Consumo de APIs", ("web_apps",)), ("Vercel", ("Vercel",)), *_GIT)),
        ("Construcción de productos", (("E-Commerce", ("commerce",)), ("Componentes reutilizables", ("React", "Next.js")), _DOCUMENTED)),
    ),
    "fullstack_junior": (
        ("Frontend y experiencia web", (*_REACT, *_SCRIPTS)),
        ("Backend y datos", (("Node.js", ("Node.js",)), ("Python", ("Python",)), *_SQL[1])),
        ("Herramientas y despliegue", (*_GIT, *_HOSTS)),
        ("Construcción de productos", (("Dashboards", ("reports",)), ("E-Commerce", ("commerce",)), ("Aplicaciones móviles", ("mobile",)))),
    ),
}
# Words written without their accents, and what they are with them; the capital form follows.
ACCENTS = {
    "en linea": "en línea", "linea de comandos": "línea de comandos", "tecnologo": "tecnólogo", "tecnologia": "tecnología", "practica": "práctica", "practicas": "prácticas", "tecnico": "técnico", "tecnicos": "técnicos",
    "documentacion": "documentación", "tecnologicos": "tecnológicos", "diagnostico": "diagnóstico", "educacion": "educación", "operacion": "operación", "linea": "línea", "computo": "cómputo", "analisis": "análisis",
    "tecnicas": "técnicas", "tecnica": "técnica", "introduccion": "introducción", "gestion": "gestión", "configuracion": "configuración", "resolucion": "resolución", "losequipos": "los equipos", "ingles": "inglés",
    "movil": "móvil", "autenticacion": "autenticación", "logica": "lógica",
}
BLOCKED_PARTS = ("mas informacion", "referencias", "disponibilidad", "hobbies", "intereses", "vehicul", "parque", "raw_text")
OFF_TOPIC = ("referencias", "hobbies", "pasatiempos", "familiares", "barras de habilidad")
# Sentences of support work, by the words of a profile that vouch for them, and the targets and roles that they serve.
SUPPORT_TARGETS, SUPPORT_TITLES = ("soporte_aplicaciones", "infraestructura_junior", "cloud_support"), ("auxiliar de oficina", "tecnico en soporte")
SUPPORT_SENTENCES = (
    ("centros de computo", "Apoyo operativo y soporte administrativo en los centros de cómputo."),
    ("recursos tecnologicos", "Gestión y organización de recursos tecnológicos en laboratorios y centros de cómputo."),
    ("automatizacion de procesos de apagado", "Automatización de procesos de apagado de equipos para optimizar el consumo y la operación."),
    ("soporte basico a usuarios", "Soporte básico a usuarios en el uso de equipos y herramientas informáticas."),
    ("registro de inventarios", "Registro de inventarios, elaboración de reportes y seguimiento al estado de los equipos."),
    ("registro y control de inventarios", "Registro y control de inventarios, reportes y novedades del centro de cómputo."),
    ("mantenimiento preventivo y correctivo", "Mantenimiento preventivo y correctivo de hardware y software en equipos de cómputo."),
    ("hojas de vida detalladas", "Documentación del historial de mantenimiento, actualizaciones y configuraciones de equipos."),
)
# What messages say about the roles that a listing names.
ROLE_SENTENCES = {
    "soporte": "Me interesa aportar en soporte a usuarios, seguimiento de incidencias, documentacion y mejora operativa.",
    "devops": "Me interesa aportar mientras sigo fortaleciendo mis habilidades en automatizacion, Linux, cloud y practicas DevOps.",
    "infraestructura": "Me interesa apoyar tareas de infraestructura, soporte operativo y estandarizacion tecnica.",
    "cloud": "Me interesa crecer en entornos cloud y soporte tecnico orientado a continuidad y operacion.",
    "qa": "Me interesa apoyar procesos de calidad, validacion y mejora continua con enfoque ordenado y tecnico.",
    "backend": "Me interesa aportar en desarrollo backend y consolidar mi base tecnica en APIs, datos y buenas practicas.",
}


def targets() -> list[str]:
    return sorted(TARGET_KEYWORDS)


def known(target: str) -> str:
    if target not in TARGET_KEYWORDS:
        raise ValueError(f"unknown target {target!r}; known: {', '.join(targets())}")
    return target


# ------------------------------------------------------------------ texts


def plain(c: Text) -> Column:
    """Clean text: mis-read characters repaired, dashes unified."""
    return F.trim(F.regexp_replace(F.translate(repair_mojibake(text(c)), "‑–—", "---"), r"(?U)\s+", " "))


def polished(c: Text) -> Column:
    """Plain text with the accents that some words lack."""

    def accented(out: Column) -> Column:
        # a cheap look spares texts without such a word all of the replacements
        fixed = out
        for word, right in ACCENTS.items():
            for a, b in ((word, right), (word[0].upper() + word[1:], right[0].upper() + right[1:])):
                fixed = F.regexp_replace(fixed, rf"(?U)\b{a}\b", b)
        return F.when(F.lower(out).rlike("|".join(ACCENTS)), fixed).otherwise(out)

    return let(plain(c), accented)


def is_blocked(c: Text, blocked=BLOCKED_PARTS) -> Column:
    return let(norm_key(plain(c)), lambda x: contains_any(x, blocked))


def distinct_skills(values: Column) -> Column:
    """Items that say something, the first of those alike without marks, case and accents."""
    key = lambda x: F.regexp_replace(norm_key(plain(x)), r"(?U)[^\w\s#+]+", "")
    ok = lambda k: (k != "") & ~k.isin(*V.TOKEN_STOPWORDS, "web", "software", "r") & ((F.length(k) >= 3) | k.isin(*V.SHORT_TOKENS)) & ~k.endswith(".vercel.app")
    kept = F.filter(F.transform(values, lambda x: F.struct(x.alias("x"), key(x).alias("k"))), lambda s: ok(s["k"]))
    return let(kept, lambda a: let(F.transform(a, lambda s: s["k"]), lambda keys: F.transform(F.filter(a, lambda s, i: F.array_position(keys, s["k"]) == i + 1), lambda s: s["x"])))


def relevant_items(values: Column, blocked=BLOCKED_PARTS) -> Column:
    """Polished items without blocked parts, other matters and mere stop words."""
    items = F.filter(F.transform(values, polished), lambda x: (x != "") & ~is_blocked(x, blocked) & ~contains_any(norm_key(x), OFF_TOPIC) & ~norm_key(x).isin(*V.TOKEN_STOPWORDS))
    return distinct_skills(items)


def known_technologies(values: Column) -> Column:
    """The known technology that each item names, the first of its names."""
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.try_element_at(technologies(x), F.lit(1))), lambda x: x.isNotNull()))


def joined_parts(values: list[Column], mark: str) -> Column:
    return F.array_join(F.filter(F.array(*values), lambda x: x != ""), mark)


# ------------------------------------------------------------------ skills


def context(*names: str) -> Column:
    """Everything that a profile says, normalised: its texts, lists, experiences and projects."""
    records = F.array_join(F.transform("experiences", lambda e: F.concat_ws(" ", e["role"], e["company"], e["location"], F.array_join(e["bullets"], " "))), " ")
    works = F.array_join(F.transform("projects", lambda p: F.concat_ws(" ", p["name"], p["role"], F.array_join(p["technologies"], " "), F.array_join(p["bullets"], " "), p["url"])), " ")
    lists = [F.array_join(c, " ") for c in ("skills", "education", "certifications", "languages")]
    return norm_key(plain(F.concat_ws(" ", *(text(n) for n in names or ("professional_summary",)), *lists, records, works)))


def signals(said: Column, found: Column) -> Column:
    """Names of all that a profile shows: signals of its text, of its roles, and its technologies."""
    supports = F.exists("experiences", lambda e: let(norm_key(F.concat_ws(" ", e["role"], e["company"])), lambda x: contains_any(x, SUPPORT_ROLES)))

    def of(x: Column) -> Column:
        def shows(name: str, words) -> Column:
            out = contains_any(x["said"], words)
            out = out | x["supports"] if name in SIGNALS_OF_SUPPORT_ROLES else out
            return out | functools.reduce(lambda a, b: a & b, (F.array_contains(x["found"], h) for h in HOSTING)) if name in SIGNALS_OF_HOSTING else out

        return F.concat(x["found"], F.array_compact(F.array(*(F.when(shows(n, w), F.lit(n)) for n, w in SIGNALS.items()))))

    return let(F.struct(said.alias("said"), found.alias("found"), supports.alias("supports")), of)


def skill_sections(shown: Column, target: str, offer: Column | None = None) -> Column:
    """Array of struct(category, skills): a target's sections with the skills that a profile shows; with a listing's words the best first."""

    def ordered(skills: Column) -> Column:
        if offer is None:
            return skills
        score = lambda s: F.size(F.filter(offer, lambda w: F.contains(norm_key(s), w)))
        return F.reverse(F.transform(F.array_sort(F.transform(skills, lambda s: F.struct(score(s).alias("n"), norm_key(s).alias("k"), s.alias("s")))), lambda x: x["s"]))

    def of(names: Column) -> Column:
        """The target's whole table of skills as data, looked through once."""
        table = F.array(*(F.struct(F.lit(category).alias("category"), F.array(*(F.struct(F.lit(skill).alias("skill"), F.array(*map(F.lit, any_of)).alias("any_of")) for skill, any_of in skills)).alias("skills")) for category, skills in TARGET_SECTIONS[known(target)]))
        held = lambda row: F.transform(F.filter(row["skills"], lambda s: F.arrays_overlap(names, s["any_of"])), lambda s: s["skill"])
        return F.filter(F.transform(table, lambda row: F.struct(row["category"].alias("category"), distinct_skills(ordered(held(row))).alias("skills"))), lambda s: F.size(s["skills"]) > 0)

    return let(shown, of)


def ranked_skills(sections: Column) -> Column:
    return distinct_skills(F.flatten(F.transform(sections, lambda s: s["skills"])))


def target_summary(sections: Column, target: str, title: Column | None = None) -> Column:
    """A target's opening, the first four skills, and the listing that it is for."""
    skills = let(F.slice(ranked_skills(sections), 1, 4), lambda best: F.when(F.size(best) > 0, F.concat(F.lit("Capacidades relevantes: "), F.array_join(best, ", "), F.lit("."))).otherwise(""))
    made_for = F.when(text(title) != "", F.concat(F.lit("Adaptado para una vacante de "), title, F.lit("."))).otherwise("") if title is not None else F.lit("")
    return polished(joined_parts([F.lit(TARGET_SUMMARIES[known(target)]), skills, made_for], " "))


# ------------------------------------------------------------------ experiences


def allowed(record: Column, blocked=BLOCKED_PARTS) -> Column:
    said = norm_key(F.concat_ws(" ", record["role"], record["company"], record["location"], record["start_date"], record["end_date"], F.array_join(record["bullets"], " ")))
    return let(said, lambda x: ~contains_any(x, (*blocked, "operador")))


def allowed_project(p: Column, blocked=BLOCKED_PARTS) -> Column:
    return ~is_blocked(F.concat_ws(" ", p["name"], p["role"], F.array_join(p["technologies"], " "), F.array_join(p["bullets"], " "), p["url"]), blocked)


def with_support_sentences(bullets: Column, role: Column, raw: Column, target: str) -> Column:
    """For support roles and targets, the sentences that the profile's text vouches for and no bullet says yet."""
    if target not in SUPPORT_TARGETS:
        return bullets
    said = norm_key(raw)
    unsaid = lambda words: ~F.exists(bullets, lambda b: norm_key(b).contains(words))
    more = F.concat(bullets, *(F.when(said.contains(words) & unsaid(words), F.array(F.lit(line))).otherwise(F.expr(NONE)) for words, line in SUPPORT_SENTENCES))
    return F.when(contains_any(norm_key(role), SUPPORT_TITLES), distinct_skills(more)).otherwise(bullets)


def prepared_bullets(bullets: Column, most: int = 3) -> Column:
    """Trimmed ideas without near-duplicates, at most so many."""
    parts = F.flatten(F.transform(bullets, lambda b: F.transform(ideas(b), lambda x: trimmed_bullet(x))))
    return F.slice(distinct_bullets(F.filter(parts, lambda x: x != "")), 1, most)


def record_header(r: Column, company_first: tuple[str, ...] = ()) -> Column:
    """'role - company | place | start - end' of what is known; the company first for those named."""
    lead = F.btrim(F.concat(r["role"], F.lit(" - "), r["company"]), F.lit(" -"))
    if company_first:
        lead = F.when(norm_key(r["company"]).isin(*company_first), F.btrim(F.concat(r["company"], F.lit(" - "), r["role"]), F.lit(" -"))).otherwise(lead)
    return joined_parts([lead, text(r["location"]), joined_parts([text(r["start_date"]), text(r["end_date"])], " - ")], " | ")


def project_header(p: Column) -> Column:
    tech = F.when(F.size(p["technologies"]) > 0, F.concat(F.lit(" ("), F.array_join(p["technologies"], ", "), F.lit(")"))).otherwise("")
    return F.concat(p["name"], F.when(p["role"] != "", F.concat(F.lit(" - "), p["role"])).otherwise(""), tech)


def contact_line(blocked=BLOCKED_PARTS) -> Column:
    parts = [polished("location"), *(plain(c) for c in ("phone", "email", "linkedin", "github", "portfolio"))]
    return F.array_join(F.filter(F.array(*parts), lambda x: (x != "") & ~is_blocked(x, blocked)), " | ")


def file_name(target: str, offer_id: Column | None = None, title: Column | None = None) -> Column:
    name = F.coalesce(F.nullif(safe_name(plain("full_name")), F.lit("")), F.lit("CV_ATS"))
    tail = F.lit(target) if offer_id is None else F.concat(F.lit("Oferta_"), offer_id.cast("string"), F.lit("_"), safe_name(F.coalesce(F.nullif(plain(title), F.lit("")), F.lit(target))))
    return F.concat(F.lit("CV_ATS_"), name, F.lit("_"), tail, F.lit(".docx"))


# ------------------------------------------------------------------ documents

BLOCK = "array<struct<style:string,text:string>>"


def _blocks(style: str, values: Column) -> Column:
    return F.transform(F.filter(values, lambda x: x != ""), lambda x: F.struct(F.lit(style).alias("style"), x.alias("text")))


def _part(title: str, blocks: Column) -> Column:
    """A heading and its blocks; nothing without any."""
    return F.when(F.size(blocks) > 0, F.concat(F.array(F.struct(F.lit("heading").alias("style"), F.lit(title).alias("text"))), blocks)).otherwise(F.expr(f"cast(array() as {BLOCK})"))


def documents(profiles: DataFrame, target: str, offer_text: Column | None = None, offer_title: Column | None = None, most: int = 5, company_first: tuple[str, ...] = (), blocked=BLOCKED_PARTS) -> DataFrame:
    """profiles with sections, summary, file_name and blocks: the paragraphs of their document in order, each with its style.

    Experiences are ranked by the words of the target and the listing, the first of each company and role kept; projects
    that are an experience's company already are left out.
    """
    offer = offer_keywords(offer_text) if offer_text is not None else None
    said = context("raw_text" if "raw_text" in profiles.columns else "professional_summary", "professional_summary")
    raw = F.col("raw_text") if "raw_text" in profiles.columns else F.lit("")
    rows = profiles.withColumn("__said", said).withColumn("__shown", signals(F.col("__said"), technologies("__said")))
    rows = rows.withColumn("__offer", offer if offer is not None else F.expr(NONE)).withColumn("sections", skill_sections(F.col("__shown"), target, F.col("__offer") if offer is not None else None))
    words = F.array(*(F.lit(w) for w in dict.fromkeys(norm for k in TARGET_KEYWORDS[known(target)] for norm in [k.translate(str.maketrans("áéíóú", "aeiou"))])))
    score = lambda t: 2 * F.size(F.filter(words, lambda w: F.contains(t, w))) + F.size(F.filter(F.col("__offer"), lambda w: F.contains(t, w)))
    line_of = lambda e: norm_key(F.concat_ws(" ", e["role"], e["company"], F.array_join(e["bullets"], " ")))
    ident = lambda e: F.concat_ws("|", norm_key(e["company"]), norm_key(e["role"]))
    usable = F.filter("experiences", lambda e: allowed(e, blocked))
    ranked = F.transform(F.array_sort(F.transform(usable, lambda e: F.struct((-score(line_of(e))).alias("s"), e["company"].alias("c"), e["role"].alias("r"), e.alias("e")))), lambda x: x["e"])
    rows = rows.withColumn("__ranked", ranked).withColumn("__ids", F.transform("__ranked", ident))
    rows = rows.withColumn("__best", F.slice(F.filter("__ranked", lambda e, i: F.array_position(F.col("__ids"), ident(e)) == i + 1), 1, most))
    rows = rows.withColumn("__best", F.transform("__best", lambda e: e.withField("bullets", prepared_bullets(with_support_sentences(e["bullets"], e["role"], raw, target)))))
    done = F.transform("__best", lambda e: norm_key(e["company"]))
    rows = rows.withColumn("__works", F.filter("projects", lambda p: allowed_project(p, blocked) & ~F.array_contains(done, norm_key(p["name"]))))
    rows = rows.withColumn("summary", target_summary(F.col("sections"), target, offer_title)).withColumn("file_name", file_name(target))
    para, item = (lambda v: _blocks("paragraph", v)), (lambda v: _blocks("bullet", v))
    jobs = F.flatten(F.transform("__best", lambda e: F.concat(para(F.array(record_header(e, company_first))), item(e["bullets"]))))
    works = F.flatten(F.transform("__works", lambda p: F.concat(para(F.array(project_header(p))), item(F.filter(F.transform(F.slice(p["bullets"], 1, 3), lambda x: trimmed_bullet(x)), lambda x: x != "")), para(F.array(plain(p["url"]))))))
    blocks = F.concat(
        _blocks("title", F.array(F.coalesce(F.nullif(polished("full_name"), F.lit("")), F.lit("CV ATS")))), para(F.array(contact_line(blocked))), _part("Perfil Profesional", para(F.array(F.col("summary")))),
        _part("Habilidades Técnicas", para(F.transform("sections", lambda s: F.concat(s["category"], F.lit(": "), F.array_join(s["skills"], ", "))))),
        _part("Experiencia Profesional y Proyectos", F.concat(jobs, works)), _part("Educación", item(relevant_items(F.col("education"), blocked))),
        _part("Certificaciones y Formación Complementaria", item(relevant_items(F.col("certifications"), blocked))), _part("Idiomas", item(relevant_items(F.col("languages"), blocked))),
    )
    return rows.withColumn("blocks", blocks).drop("__said", "__shown", "__offer", "__ranked", "__ids", "__best", "__works")


_STYLES = {"title": "Title", "heading": "Heading1", "paragraph": "Normal", "bullet": "ListBullet"}
_W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(blocks) -> bytes:
    """A DOCX file of (style, text) paragraphs."""
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{_STYLES[b["style"]]}"/></w:pPr><w:r><w:t xml:space="preserve">{escape(b["text"])}</w:t></w:r></w:p>' for b in blocks)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>')
        z.writestr("_rels/.rels", '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def with_files(made: DataFrame, name: str = "content") -> DataFrame:
    """documents() with the DOCX file of each as binary."""
    ship_package(made.sparkSession)

    @F.pandas_udf("binary")
    def files(blocks: pd.Series) -> pd.Series:
        return pd.Series([docx(b) for b in blocks])

    return made.withColumn(name, files("blocks"))


def letter_summary(summary: Text, title: Text, reasons: Column) -> Column:
    """A profile's summary, the listing that it is for, and the first reason why it fits."""
    first = F.coalesce(F.try_element_at(reasons, F.lit(1)), F.lit(""))
    return joined_parts([F.trim(text(summary)), F.concat(F.lit("Perfil orientado a la vacante de "), text(title), F.lit(".")), F.when(first != "", F.concat(F.lit("Coincidencia principal: "), first, F.lit("."))).otherwise("")], " ")


def application_message(title: Text, said: Text, full_name: Text, education: Text, skills: Text, summary: Text) -> Column:
    """A message for a listing: intro, who writes, their summary, and the sentence of the first role that the listing names."""
    focus = F.lit(ROLE_SENTENCES["backend"])
    for role, line in reversed(ROLE_SENTENCES.items()):
        focus = F.when(F.lower(text(said)).contains(role), F.lit(line)).otherwise(focus)
    who = F.concat(F.lit("Soy "), text(full_name), F.lit(", "), text(education), F.lit(", con conocimientos en "), text(skills), F.lit("."))
    return joined_parts([F.concat(F.lit("Hola, me interesa la vacante de "), text(title), F.lit(".")), who, sentence(summary), focus], " ")


__all__ = ["application_message", "col", "documents", "docx", "targets", "with_files"]
