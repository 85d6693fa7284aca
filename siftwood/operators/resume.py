"""Profile documents to records: experiences, projects, names, places and dates read from lines, cleaned and merged.

Line tests are Columns. A document's lines are one array, folded in order with native functions into an array of
records; documents are rows, so nothing is gathered across them. Words that must not get into a profile are parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import Text, clean, col, contains_any, first_non_empty, heading_key, keep_first_ci, let, pick_longer, strip_connectors, text
from ..functions.urls import tidy_url
from .profile import BULLET, identity, is_bullet
from .profile import merged_experiences as merged_by_company

# Words that tell roles, inline skills, languages and certificates.
ROLE_HINTS = ("auxiliar", "técnico", "tecnico", "desarrollador", "operador", "analista", "soporte", "ingeniero")
HEADER_ROLES = ("desarrollador", "analista", "soporte", "ingeniero", "auxiliar")
INLINE_SKILLS = (
    "Python", "Java", "C++", "C#", "JavaScript", "TypeScript", "React", "React Native", "Next.js", "Node.js", "Express", "PHP",
    "SQL", "PostgreSQL", "MySQL", "Git", "GitHub", "Linux", "Docker", "Vercel", "Neon", "MongoDB", "Redis",
)
PROJECT_TECHNOLOGIES = (
    "Python", "Java", "JavaScript", "TypeScript", "React", "Next.js", "React Native", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Vercel", "Neon", "SQL", "Node.js", "Express",
)
PROJECT_HINTS = ("react", "next.js", "dashboard", "e-commerce", "android", "aplicacion", "plataforma web")
LANGUAGE_HINTS = ("español", "espanol", "inglés", "ingles", "frances", "francés", "nativo", "lectura técnica", "lectura tecnica", "a1", "a2", "b1", "b2", "c1", "c2")
CERTIFICATION_HINTS = (
    "curso", "platzi", "frontend developer", "git y github", "linea de comandos", "línea de comandos", "javascript desde cero", "python", "java se", "mysql", "mariadb", "kotlin", "bases de datos",
)
STOP_HINTS = ("ingenieria", "tecnologia", "curso", "platzi")
BLOCKED = ("referencias", "mas informacion", "más información", "disponibilidad", "hobbies", "intereses", "vehiculos", "vehículos", "parque", "raw_text")
BLOCKED_HEADINGS = ("formacion complementaria", "formación complementaria", "habilidades", "idiomas")
_MONTH = "(?:" + "|".join(V.MONTHS) + ")"
DATE_RANGE = rf"(?i)({_MONTH}\s+\d{{4}})\s*-\s*({_MONTH}\s+\d{{4}})"
CONTACT_NOISE = r"(?i)linkedin\.com|github\.com|https?://|@|\d|[|·]"

RECORD = "struct<role:string,company:string,location:string,start_date:string,end_date:string,bullets:array<string>>"
NO_RECORDS = f"cast(array() as array<{RECORD}>)"


def words_of(c: Text) -> Column:
    return F.size(F.filter(F.split(text(c), r"\s+"), lambda w: w != ""))


# ------------------------------------------------------------------ tests of lines


def looks_like_role(line: Text) -> Column:
    return (words_of(line) <= 8) & contains_any(heading_key(line), ROLE_HINTS)


def looks_like_dates(line: Text) -> Column:
    key = heading_key(line)
    return contains_any(key, V.MONTHS) & key.rlike(r"\d")


def looks_like_place(line: Text) -> Column:
    t = text(line)
    return (t != "") & (F.length(t) <= 60) & ~t.contains("@") & ~F.lower(t).contains("http") & (words_of(t) <= 4)


def looks_like_skills(line: Text) -> Column:
    """Few words, many capitals and a known skill."""
    t = F.trim(text(line))
    capitals = F.length(t) - F.length(F.regexp_replace(t, r"\p{Lu}", ""))
    plain = F.replace(F.lower(t), F.lit("."), F.lit(""))
    return (words_of(t) <= 8) & (capitals > 0.35 * F.greatest(F.length(t), F.lit(1))) & contains_any(plain, [s.lower().replace(".", "") for s in INLINE_SKILLS])


def looks_like_language(line: Text) -> Column:
    return contains_any(heading_key(line), LANGUAGE_HINTS)


def looks_like_stop(line: Text, hints=STOP_HINTS) -> Column:
    return contains_any(heading_key(line), hints)


def ends_with_connector(line: Text) -> Column:
    last = F.lower(F.element_at(F.split(F.rtrim(F.trim(text(line)), F.lit(".,;:")), r"\s+"), -1))
    return last.isin(*V.CONNECTORS)


# ------------------------------------------------------------------ parts of lines


def place_and_dates(line: Text) -> Column:
    """struct(location, start_date, end_date) of 'place | start - end'; each may be missing."""
    t = text(line)
    halves = F.split(t, r"\|", 2)
    dates = F.trim(F.element_at(halves, -1))
    ends = F.split(dates, "–|-", 2)
    return F.struct(F.when(F.size(halves) > 1, F.trim(halves[0])).otherwise("").alias("location"), F.trim(ends[0]).alias("start_date"), F.coalesce(F.trim(F.try_element_at(ends, F.lit(2))), F.lit("")).alias("end_date"))


def role_and_dates(value: Text) -> Column:
    """struct(role, location, start_date, end_date) of 'role (place) start - end'."""
    t = F.trim(text(value))
    bare = F.trim(F.regexp_replace(t, r"\([^)]+\)", ""))
    start, end = (F.regexp_extract(bare, DATE_RANGE, i) for i in (1, 2))
    role = F.when(start != "", F.btrim(F.regexp_replace(bare, DATE_RANGE, ""), F.lit(" -"))).otherwise(bare)
    return F.struct(role.alias("role"), F.trim(F.regexp_extract(t, r"\(([^)]+)\)", 1)).alias("location"), start.alias("start_date"), end.alias("end_date"))


def company_and_dates(line: Text) -> Column:
    """struct(company, location, start_date, end_date, rest) of 'company | start - end rest' or 'company | place'."""
    t = text(line)
    halves = F.split(t, r"\|", 2)
    right = F.trim(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    start, end = (F.regexp_extract(right, DATE_RANGE, i) for i in (1, 2))
    loose, dated = place_and_dates(right), looks_like_dates(right)
    return F.struct(
        F.rtrim(F.trim(halves[0]), F.lit(".")).alias("company"), F.when(dated, "").otherwise(right).alias("location"),
        F.when(start != "", start).when(dated, loose["start_date"]).otherwise("").alias("start_date"), F.when(start != "", end).when(dated, loose["end_date"]).otherwise("").alias("end_date"),
        F.when(start != "", F.btrim(F.regexp_replace(right, DATE_RANGE, ""), F.lit(" .-"))).otherwise("").alias("rest"),
    )


def header(line: Text) -> Column:
    """The record that 'company — role (place) dates' opens; NULL for other lines. A hyphen needs a role's word besides."""
    t = text(line)
    dash = t.contains(" — ")
    opens = dash | (t.contains(" - ") & contains_any(F.lower(t), HEADER_ROLES))
    # line ends are unified before, so a long dash may come as a hyphen
    halves = F.split(t, F.when(dash, F.lit(" — ")).otherwise(F.lit(" - ")), 2)
    told = role_and_dates(F.coalesce(F.try_element_at(halves, F.lit(2)), F.lit("")))
    return F.when(opens, let(told, lambda r: _record(r["role"], F.trim(halves[0]), r["location"], r["start_date"], r["end_date"])))


def _record(role, company, location, start, end, bullets=None) -> Column:
    empty = F.expr("cast(array() as array<string>)")
    return F.struct(role.alias("role"), company.alias("company"), location.alias("location"), start.alias("start_date"), end.alias("end_date"), (empty if bullets is None else bullets).alias("bullets"))


def _with_bullet(r: Column, line: Column, glue: Column) -> Column:
    """The record with a bullet more, or with the line glued to its last one."""
    glued = F.concat(F.slice(r["bullets"], 1, F.size(r["bullets"]) - 1), F.array(F.concat(F.element_at(r["bullets"], -1), F.lit(" "), line)))
    return r.withField("bullets", F.when(glue & (F.size(r["bullets"]) > 0), glued).otherwise(F.concat(r["bullets"], F.array(line))))


def _replaced_last(done: Column, r: Column) -> Column:
    return F.concat(F.slice(done, 1, F.size(done) - 1), F.array(r))


def _last_bullet(r: Column) -> Column:
    return F.coalesce(F.try_element_at(r["bullets"], F.lit(-1)), F.lit(""))


def _trimmed(records: Column) -> Column:
    return F.transform(records, lambda r: r.withField("bullets", F.filter(F.transform(r["bullets"], lambda b: strip_connectors(clean(b), V.CONNECTORS)), lambda b: b != "")))


def experiences(lines: Column) -> Column:
    """Records of an experience section: headers open them, a line of dates and bullets fill them, short or open-ended lines go on."""

    def step(done: Column, line: Column) -> Column:
        r = F.element_at(done, -1)
        dates = place_and_dates(line)
        dated = r.withField("location", dates["location"]).withField("start_date", dates["start_date"]).withField("end_date", dates["end_date"])
        goes_on = (F.size(r["bullets"]) > 0) & (ends_with_connector(_last_bullet(r)) | (words_of(line) <= 3))
        body = (
            F.when(looks_like_dates(line), dated).when(heading_key(line).startswith("proyecto en linea"), _with_bullet(r, clean(line), F.lit(False)))
            .when(goes_on, _with_bullet(r, clean(line), F.lit(True))).when(words_of(line) > 2, _with_bullet(r, clean(line), F.lit(False))).otherwise(r)
        )
        marked = clean(F.regexp_replace(line, BULLET, ""))
        inside = F.when(is_bullet(line), F.when(marked != "", _with_bullet(r, marked, F.lit(False))).otherwise(r)).otherwise(body)
        opened = header(line)
        return F.when(~is_bullet(line) & opened.isNotNull(), F.concat(done, F.array(opened))).when(F.size(done) == 0, done).otherwise(_replaced_last(done, inside))

    return _trimmed(F.aggregate(F.filter(lines, lambda x: F.trim(x) != ""), F.expr(NO_RECORDS), step))


def experiences_anywhere(lines: Column, stop=STOP_HINTS) -> Column:
    """Records of a document without such a section: a role's line opens one, the next line may say company and dates; records with neither company nor bullets go."""
    said = F.filter(F.transform(lines, F.trim), lambda x: x != "")
    paired = let(said, lambda a: F.transform(a, lambda x, i: F.struct(x.alias("x"), F.coalesce(F.try_element_at(a, i + 2), F.lit("")).alias("next"))))
    start = F.struct(F.expr(NO_RECORDS).alias("done"), F.lit(False).alias("open"), F.lit(False).alias("skip"))

    def step(s: Column, p: Column) -> Column:
        line, after, r = p["x"], p["next"], F.element_at(s["done"], -1)
        told = after.contains("|") | looks_like_dates(after)
        # what the next line says goes in with the title; it is passed over then
        said_next = company_and_dates(after)
        none = F.lit("")
        opened = F.when(told, _record(line, said_next["company"], said_next["location"], said_next["start_date"], said_next["end_date"], F.filter(F.array(clean(said_next["rest"])), lambda b: b != ""))).otherwise(_record(line, none, none, none, none))
        goes_on = (F.size(r["bullets"]) > 0) & (ends_with_connector(_last_bullet(r)) | (words_of(line) <= 4))
        filled = F.when(looks_like_skills(line), r).when(goes_on, _with_bullet(r, clean(line), F.lit(True))).when(words_of(line) >= 3, _with_bullet(r, clean(line), F.lit(False))).otherwise(r)
        state = lambda done, open_, skip: F.struct(done.alias("done"), open_.alias("open"), skip.alias("skip"))
        yes, no = F.lit(True), F.lit(False)
        return (
            F.when(s["skip"], state(s["done"], s["open"], no)).when(looks_like_role(line), state(F.concat(s["done"], F.array(opened)), yes, told)).when(~s["open"], s)
            .when(looks_like_stop(line, stop), state(s["done"], no, no)).otherwise(state(_replaced_last(s["done"], filled), yes, no))
        )

    return F.filter(_trimmed(F.aggregate(paired, start, step, lambda s: s["done"])), lambda r: (r["company"] != "") | (F.size(r["bullets"]) > 0))


def inline_skills(raw: Text) -> Column:
    low = F.lower(text(raw))
    return let(low, lambda t: F.array_compact(F.array(*(F.when(t.contains(s.lower()), F.lit(s)) for s in INLINE_SKILLS))))


def project_technologies(raw: Text) -> Column:
    return let(F.lower(text(raw)), lambda t: F.array_compact(F.array(*(F.when(t.contains(s.lower()), F.lit(s)) for s in PROJECT_TECHNOLOGIES))))


def projects(lines: Column, records: Column) -> Column:
    """Projects: lines with a link, then experiences that have a link or sound like one; links leave the bullets, of which four stay."""
    named = F.transform(F.filter(lines, lambda x: F.lower(x).contains("http")), lambda x: F.struct(
        F.btrim(F.substring_index(x, "http", 1), F.lit(" :")).alias("name"), F.lit("").alias("role"), F.expr("cast(array() as array<string>)").alias("technologies"), F.expr("cast(array() as array<string>)").alias("bullets"),
        F.regexp_extract(x, "(http.*)$", 1).alias("url"),
    ))

    def of(r: Column) -> Column:
        links = F.filter(F.transform(r["bullets"], lambda b: F.rtrim(F.regexp_extract(b, r"https?://\S+", 0), F.lit(".,)"))), lambda u: u != "")
        plain = F.filter(r["bullets"], lambda b: ~b.rlike(r"https?://\S"))
        said = F.concat_ws(" ", r["role"], F.array_join(r["bullets"], " "))
        return F.struct(r["company"].alias("name"), r["role"].alias("role"), project_technologies(said).alias("technologies"), F.slice(plain, 1, 4).alias("bullets"), F.coalesce(F.try_element_at(links, F.lit(-1)), F.lit("")).alias("url"))

    sounds = lambda r: contains_any(F.lower(F.concat_ws(" ", r["company"], r["role"], F.array_join(r["bullets"], " "))), PROJECT_HINTS)
    linked = lambda r: F.exists(r["bullets"], lambda b: b.rlike(r"https?://\S"))
    return F.concat(named, F.transform(F.filter(records, lambda r: linked(r) | sounds(r)), of))


def section_items(lines: Column) -> Column:
    """Items without marks, connectors at their ends and lines about references."""
    items = F.transform(lines, lambda x: strip_connectors(clean(F.regexp_replace(x, BULLET, "")), V.CONNECTORS))
    return F.filter(items, lambda x: (x != "") & ~heading_key(x).contains("referenc"))


def summary_from(lines: Column, roles: Column) -> Column:
    """The first two lines of twelve words or more before the first role, without mail addresses and links."""
    keys = F.transform(roles, heading_key)
    before = F.aggregate(lines, F.struct(F.expr("cast(array() as array<string>)").alias("a"), F.lit(True).alias("on")), lambda s, x: F.struct(
        F.when(s["on"] & ~F.array_contains(keys, heading_key(x)) & (words_of(x) >= 12) & ~x.contains("@") & ~x.contains("http"), F.concat(s["a"], F.array(F.trim(x)))).otherwise(s["a"]).alias("a"),
        (s["on"] & ~F.array_contains(keys, heading_key(x))).alias("on"),
    ), lambda s: s["a"])
    return F.array_join(F.slice(before, 1, 2), " ")


# ------------------------------------------------------------------ clean values


def without_contact(c: Text, most: int = 5) -> Column:
    """A name up to the first contact mark or digit, at most so many words."""
    head = F.btrim(F.split(text(c), CONTACT_NOISE, 2)[0], F.lit(" ,-"))
    return F.array_join(F.slice(F.filter(F.split(head, r"\s+"), lambda w: w != ""), 1, most), " ")


def full_name(first_line: Text, stem: Text) -> Column:
    """The first line as a name; where it ends in an initial, the file's name if that has four words."""
    name = without_contact(first_line)
    file = clean(F.regexp_replace(F.replace(text(stem), F.lit("_"), F.lit(" ")), r"(?i)^(HV|CV)\s+", ""))
    return F.when(name.rlike(r"\b[A-Z]\.$") & (words_of(file) >= 4), file).otherwise(name)


def place(c: Text) -> Column:
    return clean(F.btrim(F.split(text(c), CONTACT_NOISE, 2)[0], F.lit(" ,-")))


def line(c: Text, blocked=BLOCKED) -> Column:
    """A clean line; '' for headings, long lines and those with a blocked word."""
    t = clean(c)
    return let(t, lambda x: F.when(contains_any(heading_key(x), blocked) | heading_key(x).isin(*BLOCKED_HEADINGS) | (F.length(x) > 220), "").otherwise(x))


def bullet(c: Text, blocked=BLOCKED) -> Column:
    t = F.trim(F.split(F.regexp_replace(clean(c), BULLET, ""), r"(?i)\bOperador\b", 2)[0])
    return let(t, lambda x: F.when(contains_any(heading_key(x), (*blocked, "formacion academica", "vehicul")), "").otherwise(x))


def summary(c: Text, blocked=BLOCKED) -> Column:
    """A clean summary; of more than eighty words its first two sentences."""
    short = lambda x: F.array_join(F.slice(F.split(x, r"(?<=[.!?])\s+"), 1, 2), " ")
    return let(line(c, (*blocked, "experiencia laboral", "formacion academica")), lambda x: F.when(words_of(x) > 80, short(x)).otherwise(x))


def url(c: Text, blocked=BLOCKED) -> Column:
    return F.when((F.trim(text(c)) == "") | contains_any(heading_key(c), blocked), "").otherwise(tidy_url(F.trim(text(c))))


def certificates(c: Text, blocked=BLOCKED) -> Column:
    """The certificates that a line lists."""
    parts = F.transform(F.split(text(c), "[•|]"), lambda x: line(x, blocked))
    return F.filter(parts, lambda x: (x != "") & ~heading_key(x).startswith("formacion complementaria"))


def clean_experiences(records: Column, blocked=BLOCKED, gone=("operador",)) -> Column:
    """Records of clean parts; those with neither role nor company, and those of a role named in gone, go."""
    keep = F.filter(records, lambda r: ((line(r["role"], blocked) != "") | (line(r["company"], blocked) != "")) & ~heading_key(r["role"]).isin(*gone))
    return F.transform(keep, lambda r: _record(*(line(r[f], blocked) for f in ("role", "company", "location", "start_date", "end_date")), keep_first_ci(F.transform(r["bullets"], lambda b: bullet(b, blocked)))))


def clean_projects(values: Column, blocked=BLOCKED) -> Column:
    return F.transform(values, lambda p: F.struct(
        line(p["name"], blocked).alias("name"), line(p["role"], blocked).alias("role"), F.filter(F.transform(p["technologies"], lambda t: line(t, blocked)), lambda t: t != "").alias("technologies"),
        keep_first_ci(F.transform(p["bullets"], lambda b: bullet(b, blocked))).alias("bullets"), url(p["url"], blocked).alias("url"),
    ))


def merged_projects(values: Column) -> Column:
    """The first project of each name, role and link."""
    key = lambda p: F.concat_ws("|", heading_key(p["name"]), heading_key(p["role"]), heading_key(p["url"]))
    return let(F.transform(values, key), lambda keys: F.filter(values, lambda p, i: F.array_position(keys, key(p)) == i + 1))


def better_name(a: Text, b: Text) -> Column:
    """The first name of three words or more; without one the first known."""
    x, y = without_contact(a), without_contact(b)
    return F.when(words_of(x) >= 3, x).when(words_of(y) >= 3, y).otherwise(first_non_empty(x, y))


def better_place(a: Text, b: Text) -> Column:
    x, y = place(a), place(b)
    return F.when(looks_like_place(x), x).when(looks_like_place(y), y).otherwise(first_non_empty(x, y))


def better_email(a: Text, b: Text) -> Column:
    x, y = (F.regexp_replace(text(c), r"\s+", "") for c in (a, b))
    return F.when(x.contains("@"), x).when(y.contains("@"), y).otherwise(first_non_empty(x, y))


def better_url(a: Text, b: Text) -> Column:
    tidy = lambda c: F.when(F.trim(text(c)) == "", "").otherwise(tidy_url(text(c)))
    return first_non_empty(tidy(a), tidy(b))


# ------------------------------------------------------------------ tables


def with_records(parsed: DataFrame, lines: str, section: str = "experience_lines", project_section: str = "project_lines") -> DataFrame:
    """parsed profiles (profile.parsed) with experiences, projects and a summary; lines: all lines of a document, for those without the sections."""
    found = experiences(F.coalesce(F.col(section), F.expr("cast(array() as array<string>)")))
    rows = parsed.withColumn("experiences", let(found, lambda e: F.when(F.size(e) > 0, e).otherwise(experiences_anywhere(F.col(lines)))))
    rows = rows.withColumn("projects", projects(F.coalesce(F.col(project_section), F.expr("cast(array() as array<string>)")), F.col("experiences")))
    fallback = summary_from(F.col(lines), F.transform("experiences", lambda e: e["role"]))
    rows = rows.withColumn("professional_summary", first_non_empty("professional_summary", fallback))
    return rows.withColumn("skills", F.when(F.size("skills") > 0, F.col("skills")).otherwise(inline_skills(F.array_join(lines, " ")))).drop(section, project_section)


def cleaned(profiles: DataFrame, key: str, blocked=BLOCKED) -> DataFrame:
    """Profiles of clean values: certificates sorted out of education, languages that are ones, experiences of one company and role made one."""
    none = F.expr("cast(array() as array<string>)")
    lists = lambda c: F.filter(F.transform(F.coalesce(F.col(c), none), lambda x: line(x, blocked)), lambda x: x != "")
    is_certificate = lambda x: contains_any(heading_key(x), CERTIFICATION_HINTS)
    rows = profiles.withColumn("__both", F.concat(lists("education"), lists("certifications"))).withColumns({
        "full_name": line("full_name", blocked), "location": line("location", blocked), "phone": clean("phone"), "email": F.regexp_replace(text("email"), r"\s+", ""),
        **{c: url(c, blocked) for c in ("linkedin", "github", "portfolio")}, "professional_summary": summary("professional_summary", blocked), "skills": lists("skills"),
        "languages": keep_first_ci(F.filter(lists("languages"), looks_like_language)), "projects": clean_projects(F.col("projects"), blocked), "experiences": clean_experiences(F.col("experiences"), blocked),
    })
    rows = rows.withColumns({"education": keep_first_ci(F.filter("__both", lambda x: ~is_certificate(x))), "certifications": keep_first_ci(F.flatten(F.transform(F.filter("__both", is_certificate), lambda x: certificates(x, blocked))))}).drop("__both")
    # a profile's experiences go through the aggregate that merges those of several documents
    each = rows.select(key, F.posexplode("experiences").alias("seq", "e")).select(key, "seq", "e.*")
    one = merged_by_company(each.withColumn("__first", F.col("seq")), key)
    order = each.select(key, identity("company", "role").alias("__i"), "seq").groupBy(key, "__i").agg(F.min("seq").alias("__s"))
    placed = one.withColumn("__i", identity("company", "role")).join(order, [key, "__i"])
    record = F.struct("__s", F.struct("role", "company", "location", "start_date", "end_date", "bullets").alias("r"))
    gathered = placed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(record)), lambda x: x["r"]).alias("__e"))
    return rows.join(gathered, key, "left").withColumn("experiences", F.coalesce("__e", F.expr(NO_RECORDS))).drop("__e")


def merged(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Two versions of profiles made one, field by field; a profile that only one side has stays as it is."""
    a, b = primary.alias("a"), secondary.alias("b")
    both = a.join(b, key, "full_outer")
    x, y = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    pick = {"full_name": better_name, "location": better_place, "email": better_email, "linkedin": better_url, "github": better_url, "portfolio": better_url}
    out = [F.col(key)]
    for c, t in primary.dtypes:
        none = F.expr(f"cast(array() as {t})") if t.startswith("array") else None
        if c == key:
            continue
        if t == "array<string>":
            out.append(keep_first_ci(F.concat(F.coalesce(x(c), none), F.coalesce(y(c), none))).alias(c))
        elif c == "projects":
            out.append(merged_projects(F.concat(F.coalesce(x(c), none), F.coalesce(y(c), none))).alias(c))
        elif t.startswith("array"):
            out.append(F.concat(F.coalesce(x(c), none), F.coalesce(y(c), none)).alias(c))
        else:
            out.append(pick.get(c, pick_longer)(x(c), y(c)).alias(c))
    return both.select(*out)


__all__ = ["cleaned", "col", "company_and_dates", "experiences", "experiences_anywhere", "header", "merged", "projects", "with_records"]
