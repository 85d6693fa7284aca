"""Profile documents: lines glued, sections and records found, near-duplicate bullets dropped, records merged and ranked.

A document's lines are one array, folded in order with native array functions; documents are rows, so all is spread by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import month_year
from ..functions.text import Text, cap_words, clean, col, first_non_empty, heading_key, keep_first_ci, norm_key, pick_longer, repair_mojibake, text
from ..functions.urls import first_url_with, first_url_without, tidy_url
from .scoring import technologies, weighted_hits

# Section names by their headings, and patterns of contact fields and bullets.
SECTIONS = {
    "perfil profesional": "summary", "perfil": "summary", "resumen profesional": "summary", "habilidades y competencias": "skills", "habilidades tecnicas": "skills",
    "habilidades": "skills", "experiencia profesional": "experience", "experiencia": "experience", "proyectos": "projects", "educacion": "education",
    "formacion complementaria": "certifications", "certificaciones": "certifications", "idiomas": "languages", "referencias": "references",
}
EMAIL = r"[\w.\-+]+\s*@\s*[\w.\-]+\.\w+"
PHONE = r"(\+?\d[\d\s().-]{7,}\d)"
URL = r"(?i)(https?://\S+|(?:linkedin|github)\.com/\S+|(?:www\.)?\S+\.\w{2,}/\S*)"
BULLET = r"^[•●\-*]\s*"
CONTACT_MARKS = ("email:", "tel:", "telefono:", "linkedin:", "github:")
NONE = "cast(array() as array<string>)"


def is_heading(line: Text, sections=SECTIONS) -> Column:
    key = heading_key(line)
    upper = (F.upper(col(line)) == col(line)) & col(line).rlike(r"\p{L}") & (F.size(F.split(clean(line), " ")) <= 5)
    return key.isin(*sections) | upper


def is_bullet(line: Text) -> Column:
    return col(line).rlike(BULLET)


def cleaned_lines(raw: Text) -> Column:
    """Lines with white space and dashes unified, line ends in a sentence glued to the line before; blank runs become one blank line."""
    t = repair_mojibake(F.translate(text(raw), "\r\u0000‑–— ", "\n --- "))
    lines = F.transform(F.split(F.regexp_replace(t, r"[^\S\n]+", " "), "\n"), lambda x: F.regexp_replace(F.trim(x), r"\s+\|\s+", " | "))
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(""))

    def joins(previous: Column, line: Column) -> Column:
        low = F.lower(line)
        contact = F.lit(False)
        for m in CONTACT_MARKS:
            contact = contact | low.contains(m)
        stops = previous.rlike(r"[.:|]$") | contact | line.contains("|") | line.endswith(":") | line.rlike("^https?://") | is_heading(line)
        return (previous != "") & ~is_heading(previous) & ~is_bullet(line) & ~stops & previous.rlike(r"^[\pL\pN]") & line.rlike(r"^[\pL\pN]")

    def step(done: Column, line: Column) -> Column:
        glued = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.concat(last(done), F.lit(" "), line)))
        blank = F.when((F.size(done) > 0) & (last(done) != ""), F.concat(done, F.array(F.lit("")))).otherwise(done)
        return F.when(line == "", blank).when((F.size(done) > 0) & joins(last(done), line), glued).otherwise(F.concat(done, F.array(line)))

    return F.aggregate(lines, F.expr(NONE), step)


def sectioned(lines: DataFrame, doc: str, pos: str, line: str, sections=SECTIONS) -> DataFrame:
    """lines with section: that of the last heading before, 'header' before any; headings themselves are left out."""
    names = F.create_map(*(F.lit(x) for kv in sections.items() for x in kv))
    rows = lines.withColumn("__opens", F.try_element_at(names, heading_key(line)))
    w = Window.partitionBy(doc).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("section", F.coalesce(F.last("__opens", ignorenulls=True).over(w), F.lit("header"))).where("__opens is null").drop("__opens")


def records(lines: DataFrame, group: str, pos: str, opens: Column, item: str) -> DataFrame:
    """(group, record, head, items): a line that opens starts a record, the lines after it are its items; lines before the first are dropped."""
    w = Window.partitionBy(group).orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("__open", F.coalesce(opens, F.lit(False))).withColumn("record", F.sum(F.col("__open").cast("int")).over(w).cast("int")).where("record > 0")
    items = F.array_sort(F.collect_list(F.when(~F.col("__open"), F.struct(F.col(pos).alias("pos"), F.col(item).alias("item")))))
    return rows.groupBy(group, "record").agg(F.max(F.when(F.col("__open"), F.col(item))).alias("head"), F.transform(items, lambda i: i["item"]).alias("items"))


def signature(bullet: Column, stop=V.TOKEN_STOPWORDS) -> Column:
    found = F.array_distinct(F.regexp_extract_all(norm_key(bullet), F.lit("[a-z0-9#+]+"), 0))
    return F.filter(found, lambda t: ~t.isin(*stop, "proyecto", "linea") & (F.length(t) >= 3))


def similar(a: Column, b: Column) -> Column:
    """Signatures that contain one another (four words at least), or share four and three quarters of the larger."""
    both, n, m = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return (both > 0) & (((both >= F.least(n, m)) & (F.least(n, m) >= 4)) | ((both >= 4) & (both * 4 >= F.greatest(n, m) * 3)))


def distinct_bullets(bullets: Text) -> Column:
    """Bullets in order without those similar to one kept before; without words: dropped."""
    signed = F.filter(F.transform(col(bullets), lambda b: F.struct(b.alias("b"), signature(b).alias("s"))), lambda x: F.size(x["s"]) > 0)
    start = F.expr("cast(array() as array<struct<b:string,s:array<string>>>)")
    kept = F.aggregate(signed, start, lambda done, x: F.when(F.exists(done, lambda k: similar(k["s"], x["s"])), done).otherwise(F.concat(done, F.array(x))))
    return F.transform(kept, lambda x: x["b"])


def ideas(bullet: Column) -> Column:
    """Sentences of a bullet, without its mark."""
    t = F.regexp_replace(clean(bullet), r"^[•●\-*]+\s*", "")
    return F.filter(F.split(t, r"(?<=[.!?])\s+(?=[A-ZÁÉÍÓÚÑ])"), lambda x: F.trim(x) != "")


def trimmed_bullet(bullet: Column, most: int = 32, blocked=()) -> Column:
    """A bullet of at most so many words without connectors at its end; '' if it holds a blocked part."""
    out = F.rtrim(cap_words(F.regexp_replace(clean(bullet), r"^[•●\-*]+\s*", ""), most, V.CONNECTORS), F.lit(",;:"))
    bad = F.lit(False)
    for b in blocked:
        bad = bad | norm_key(bullet).contains(b)
    return F.when(bad | norm_key(out).isin(*V.TOKEN_STOPWORDS), "").otherwise(out)


def relevant_bullets(bullets: Text, target_terms, offer_terms, blocked=()) -> Column:
    """Bullets with a score, best first and in order among equals (all, if none has one), cut into trimmed ideas, near-duplicates dropped."""
    scored = F.transform(col(bullets), lambda b, i: F.struct((-weighted_hits(norm_key(b), target_terms, offer_terms)).alias("s"), i.alias("i"), b.alias("b")))
    best = F.filter(F.array_sort(scored), lambda x: x["s"] < 0)
    chosen = F.when(F.size(best) > 0, F.transform(best, lambda x: x["b"])).otherwise(col(bullets))
    parts = F.flatten(F.transform(chosen, lambda b: F.transform(ideas(b), lambda x: trimmed_bullet(x, blocked=blocked))))
    return distinct_bullets(F.filter(parts, lambda x: x != ""))


def identity(company: Text, role: Text) -> Column:
    return F.concat_ws("|", norm_key(company), norm_key(role))


def ranked_experiences(experiences: DataFrame, doc: str, target_terms, offer_terms, priority: dict[str, int] | None = None, most: int = 5) -> DataFrame:
    """Experiences of each profile by priority, score, company and role; the first of each identity, at most so many."""
    order_of = F.lit(999) if not priority else F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in priority.items() for x in kv)), identity("company", "role")), F.lit(999))
    all_text = norm_key(F.concat_ws(" ", "role", "company", F.array_join("bullets", " ")))
    rows = experiences.withColumns({"__id": identity("company", "role"), "__p": order_of, "score": weighted_hits(all_text, target_terms, offer_terms)})
    order = [F.col("__p"), F.col("score").desc(), F.col("company"), F.col("role")]
    rows = rows.withColumn("__n", F.row_number().over(Window.partitionBy(doc, "__id").orderBy(*order))).where("__n = 1")
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(doc).orderBy(*order))).where(F.col("position") <= most).drop("__n", "__id", "__p")


def uncovered_projects(projects: DataFrame, experiences: DataFrame, doc: str) -> DataFrame:
    """Projects whose name is not the company of an experience of the same profile."""
    done = experiences.select(doc, norm_key("company").alias("__k"))
    return projects.withColumn("__k", norm_key("name")).join(done, [doc, "__k"], "left_anti").drop("__k")


def boundary_date(value: str, earliest: bool, seq: str = "seq") -> Column:
    """Aggregate: the text with the earliest or latest month and year, the first of equal ones; where none has a month, the last text by seq."""
    when = month_year(value)
    dated = lambda place: F.when(when.isNotNull(), F.struct(when, place))
    best = F.min_by(value, dated(F.col(seq))) if earliest else F.max_by(value, dated(-F.col(seq)))
    return F.coalesce(best, F.max_by(value, F.when(F.col(value).isNotNull(), F.col(seq))))


def merged_experiences(rows: DataFrame, doc: str, seq: str = "seq") -> DataFrame:
    """Experiences of one company and role made one: earliest start, latest end, the bullets of all, the first place known.

    Bullets are made distinct by an aggregate of their own before any list is gathered.
    """
    keys = [doc, "__c", "__r"]
    keyed = rows.withColumns({"__c": norm_key("company"), "__r": norm_key("role")})
    merged = keyed.groupBy(*keys).agg(
        F.min_by("company", seq).alias("company"), F.min_by("role", seq).alias("role"), F.coalesce(F.min_by("location", F.when(text("location") != "", F.col(seq))), F.lit("")).alias("location"),
        boundary_date("start_date", True, seq).alias("start_date"), boundary_date("end_date", False, seq).alias("end_date"),
    )
    each = keyed.select(*keys, F.col(seq).alias("__s"), F.posexplode("bullets").alias("__i", "__b")).withColumn("__b", F.trim(text("__b"))).where("__b <> ''")
    first = each.groupBy(*keys, F.lower("__b").alias("__k")).agg(F.min(F.struct("__s", "__i", "__b")).alias("__x"))
    lists = first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list("__x")), lambda x: x["__b"]).alias("bullets"))
    return merged.join(lists, keys, "left").withColumn("bullets", F.coalesce("bullets", F.expr(NONE))).drop("__c", "__r")


def contact(raw: Text) -> Column:
    """struct(email, phone, linkedin, github, portfolio) found in a text."""
    urls = F.regexp_extract_all(text(raw), F.lit(URL), 0)
    pick = lambda u: F.when(u == "", "").otherwise(tidy_url(u))
    return F.struct(
        F.regexp_replace(F.regexp_extract(text(raw), EMAIL, 0), r"\s+", "").alias("email"), F.regexp_replace(F.regexp_extract(text(raw), PHONE, 1), r"\s+", " ").alias("phone"),
        pick(first_url_with(urls, "linkedin.com")).alias("linkedin"), pick(first_url_with(urls, "github.com")).alias("github"), pick(first_url_without(urls, "linkedin.com", "github.com")).alias("portfolio"),
    )


def parsed(documents: DataFrame, doc: str, raw: str) -> DataFrame:
    """(doc, full_name, location, contact fields, summary, skills, education, certifications, languages, technologies, experience lines) of profile texts."""
    lines = documents.select(doc, F.posexplode(cleaned_lines(raw)).alias("pos", "line"))
    rows = sectioned(lines, doc, "pos", "line").where("line <> ''")
    items = lambda s: F.transform(F.array_sort(F.collect_list(F.when(F.col("section") == s, F.struct("pos", F.regexp_replace("line", BULLET, "").alias("x"))))), lambda i: i["x"])
    found = rows.groupBy(doc).agg(
        F.min_by("line", "pos").alias("full_name"), items("header").alias("__head"), F.array_join(items("summary"), " ").alias("professional_summary"), items("skills").alias("__skills"),
        items("education").alias("education"), items("certifications").alias("certifications"), items("languages").alias("languages"), items("experience").alias("experience_lines"), items("projects").alias("project_lines"),
    )
    found = found.withColumn("location", F.trim(F.split_part(F.coalesce(F.try_element_at("__head", F.lit(2)), F.lit("")), F.lit("|"), F.lit(1))))
    found = found.withColumn("skills", keep_first_ci(F.flatten(F.transform("__skills", lambda s: F.split(F.translate(s, "()", ",,"), "[•,;|]"))))).drop("__skills", "__head")
    return found.join(documents.select(doc, "*" if doc != raw else raw, contact(raw).alias("__c"), technologies(raw).alias("technologies")).select(doc, "__c.*", "technologies"), doc)


def merged_profiles(primary: DataFrame, secondary: DataFrame, key: str) -> DataFrame:
    """Two versions of profiles, field by field: the longer text, the first contact field known, the union of lists."""
    a, b = primary.alias("a"), secondary.alias("b")
    both = a.join(b, key, "full_outer")
    out = []
    for c, t in primary.dtypes:
        if c == key:
            out.append(F.col(key))
        elif t == "array<string>":
            out.append(keep_first_ci(F.concat(F.coalesce(F.col(f"a.{c}"), F.expr(NONE)), F.coalesce(F.col(f"b.{c}"), F.expr(NONE)))).alias(c))
        elif c in ("professional_summary", "full_name"):
            out.append(pick_longer(f"a.{c}", f"b.{c}").alias(c))
        else:
            out.append(first_non_empty(f"a.{c}", f"b.{c}").alias(c))
    return both.select(*out)
