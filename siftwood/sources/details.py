"""Detail pages to listings: structured data first, then what selectors find, then what the listing had.

Selectors run in Arrow batches and return plain lists of texts; every choice among them is a Column.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import published
from ..functions.text import Text, clean, col, contains_any, let, norm_soft, text
from ..operators.scoring import modality
from ..shared import small_batches
from ..shipping import ship_package
from .html import job_posting, posting_fields, select, tree


def tidy(c: Text) -> Column:
    """Clean, bullets as blanks, no blanks or hyphens at the ends."""
    return F.btrim(clean(F.regexp_replace(clean(c), r"\s*•\s*", " ")), F.lit(" -"))


def paragraphs(values: Column) -> Column:
    """Tidied, non-empty texts a line each, the first of those that differ in case only."""
    lines = F.filter(F.transform(values, tidy), lambda x: x != "")
    return let(lines, lambda a: let(F.transform(a, norm_soft), lambda keys: F.array_join(F.filter(a, lambda x, i: F.array_position(keys, norm_soft(x)) == i + 1), "\n")))


def is_furniture(c: Text) -> Column:
    """Texts about the page rather than the job."""
    t = norm_soft(c)
    return (t == "") | contains_any(t, V.FURNITURE)


def first_tidy(values: Column) -> Column:
    """The first text that has any; NULL without one."""
    return F.try_element_at(F.filter(F.transform(values, tidy), lambda x: x != ""), F.lit(1))


def requirements_in(description: Text) -> Column:
    """The first five sentences after a heading of requirements, up to one of benefits; ''."""
    tail = F.regexp_extract(text(description), r"(?is)\bRequisitos\b[:\s]*(.+)", 1)
    before = F.split(tail, r"(?i)\bBeneficios\b")[0]
    parts = F.filter(F.transform(F.split(before, r"[\n.]+"), tidy), lambda x: x != "")
    return paragraphs(F.slice(parts, 1, 5))


def with_found(pages: DataFrame, html: str = "html", name: str = "found", selectors: dict | None = None) -> DataFrame:
    """pages with a struct of arrays: per field the distinct texts that its selectors find, in order."""
    ship_package(pages.sparkSession)
    small_batches(pages.sparkSession)
    wanted = selectors or V.DETAIL_SELECTORS

    @F.pandas_udf("struct<" + ", ".join(f"{f}: array<string>" for f in wanted) + ">")
    def found(htmls: pd.Series) -> pd.DataFrame:
        rows = []
        for h in htmls:
            root = tree(h or "")
            rows.append({f: list(dict.fromkeys(t for s in many for n in select(root, s) if (t := n.text()))) for f, many in wanted.items()})
        return pd.DataFrame(rows, columns=list(wanted))

    return pages.withColumn(name, found(html))


def merged(listings: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """listings (title to requirements, modality, raw_posted_text, published_at, found_at) with the fields of their detail pages (key, html).

    A missing, empty or broken page leaves the listing as it was. Of several pages of a key one counts.
    """
    one = pages.groupBy(key).agg(F.min("html").alias("html"))
    told = with_found(one).select(key, F.struct(posting_fields(job_posting("html")).alias("p"), F.col("found").alias("f")).alias("__d"))
    rows = listings.join(told, key, "left")
    p, f = (lambda n: F.col(f"__d.p.{n}")), (lambda n: F.col(f"__d.f.{n}"))
    first = lambda n, had, posting=None: F.coalesce(F.nullif(tidy(p(posting or n)), F.lit("")), first_tidy(f(n)), col(had))
    priced = F.try_element_at(F.filter(F.transform(f("salary"), tidy), lambda x: x.rlike(r"(?i)[$€£]|cop|usd|\d")), F.lit(1))
    rows = rows.withColumns({
        "title": first("title", "title"), "company": first("company", "company"), "location": first("location", "location"),
        "salary": F.coalesce(F.nullif(p("salary"), F.lit("")), priced, F.col("salary")),
        "raw_posted_text": first("posted", "raw_posted_text", "published"),
        "description": F.coalesce(F.nullif(paragraphs(F.filter(f("description"), lambda x: ~is_furniture(x))), F.lit("")), F.nullif(p("description"), F.lit("")), F.col("description")),
    })
    own = paragraphs(F.filter(f("requirements"), lambda x: ~F.contains(F.col("description"), x)))
    required = F.coalesce(F.nullif(own, F.lit("")), F.nullif(requirements_in("description"), F.lit("")), F.nullif(text("requirements"), F.lit("")), F.col("description"))
    rows = rows.withColumn("requirements", F.when(F.col("__d").isNull(), F.col("requirements")).otherwise(required))
    said = F.try_element_at(F.filter(F.transform(f("modality"), lambda x: modality(x)), lambda x: x != ""), F.lit(1))
    rows = rows.withColumn("modality", F.coalesce(said, F.nullif(text("modality"), F.lit("")), modality("location", "description", "requirements")))
    when = published("raw_posted_text", F.col("found_at"))
    return rows.withColumn("published_at", F.when(F.col("__d").isNull(), F.col("published_at")).otherwise(F.coalesce(when, F.col("published_at")))).drop("__d")
