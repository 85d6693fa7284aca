"""Pages of a portal behind a login: whether they show cards, nothing, or a wall, and what an open detail panel says."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.text import Text, norm_soft, text
from ..functions.urls import filter_codes, search_url
from ..shipping import ship_package
from .html import Node, application_type_of, first_text, select, tree

STATE = "struct<public_cards: boolean, logged_cards: boolean, no_results: boolean, reason: string, kind: string, description: string, application_type: string>"


def _any(node: Node, selectors) -> bool:
    return any(select(node, s) for s in selectors)


def has_public_cards(root: Node) -> bool:
    return _any(root, V.PUBLIC_CARDS)


def has_logged_cards(root: Node) -> bool:
    return _any(root, V.LOGGED_CARDS) or any(_any(n, V.LOGGED_ITEMS) for n in select(root, V.LOGGED_LIST)[:1])


def wall(root: Node, html: str, url: str, has_content: bool, needs_content: bool = True) -> tuple[str, str]:
    """(reason, kind) of the first sign that a page keeps its listings back; ('', '') without one. Login walls count only without content."""
    fold = lambda t: " ".join(t.split()).casefold()
    said = " ".join((fold(root.text()), fold(html), fold(url)))
    checks = [(token in said, (reason, kind)) for token, reason, kind in V.WALL_TEXTS]
    checks += [(not has_content and token in said, ("authwall", "login")) for token in V.LOGIN_WALL_TEXTS]
    checks += [(bool(select(root, s)), (reason, kind)) for s, reason, kind in V.WALL_SELECTORS]
    checks += [(not has_content and _any(root, V.LOGIN_WALL_SELECTORS), ("authwall", "login"))]
    checks += [(not has_content and any(t in said for t in V.SOFT_LOGIN_TEXTS), ("login requerido", "login"))]
    checks += [(needs_content and not has_content, ("sin cards publicas de LinkedIn", "blocked"))]
    return next((result for true, result in checks if true), ("", ""))


def page_state(html: str, url: str = "", detail: bool = False) -> dict:
    """What a page shows. A list page with cards, or that says there are no results, is not blocked; a detail page shows its description."""
    root = tree(html)
    public, logged = has_public_cards(root), has_logged_cards(root)
    seen = " ".join(root.text().split()).casefold()
    none = any(t in seen for t in V.NO_RESULTS)
    description = first_text(root, ("div.description__text",))
    reason, kind = wall(root, html, url, bool(description), False) if detail else ("", "") if public or logged or none else wall(root, html, url, False)
    return {"public_cards": public, "logged_cards": logged, "no_results": none, "reason": reason, "kind": kind, "description": description, "application_type": application_type_of(root)}


def with_state(pages: DataFrame, html: str = "html", url: str = "url", name: str = "state", detail: bool = False) -> DataFrame:
    """pages with page_state() as a struct."""
    ship_package(pages.sparkSession)

    @F.pandas_udf(STATE)
    def states(htmls: pd.Series, urls: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([page_state(h or "", u or "", detail) for h, u in zip(htmls, urls, strict=True)], columns=["public_cards", "logged_cards", "no_results", "reason", "kind", "description", "application_type"])

    return pages.withColumn(name, states(html, url))


def with_details(listings: DataFrame, pages: DataFrame, key: str) -> DataFrame:
    """listings with description and application type of their detail pages (key, html, url); a page behind a wall changes nothing."""
    one = pages.groupBy(key).agg(F.min_by("html", "html").alias("html"), F.min_by("url", "html").alias("url"))
    told = with_state(one, detail=True).where("state.reason = ''").select(key, F.col("state").alias("__s"))
    rows = listings.join(told, key, "left")
    kind = F.nullif(F.col("__s.application_type"), F.lit(V.UNKNOWN_APPLY))
    return rows.withColumns({"description": F.coalesce(F.nullif(F.col("__s.description"), F.lit("")), F.col("description")), "application_type": F.coalesce(kind, F.col("application_type"))}).drop("__s")


def jobs_url(keyword: Text, location: Text, date_posted: Text = "24h", experience: Column | None = None, workplace: Column | None = None) -> Column:
    """Search URL of the portal with its filter codes; a missing keyword or place and unknown filter names are errors. 'any' date: no filter."""
    need = lambda c, name: F.when(F.trim(text(c)) == "", F.raise_error(F.lit(f"a search needs a {name}")).cast("string")).otherwise(F.trim(text(c)))
    date = norm_soft(F.lit(date_posted) if date_posted in V.DATE_POSTED_CODES or date_posted in ("any", "") else date_posted)
    coded = F.array_join(filter_codes(F.filter(F.array(date), lambda d: ~d.isin("any", "")), V.DATE_POSTED_CODES, "date_posted"), ",")
    codes = lambda c, table, name: F.replace(F.array_join(filter_codes(F.filter(c, lambda v: F.trim(v) != ""), table, name), ","), F.lit(" "), F.lit("")) if c is not None else F.lit("")
    url = search_url("https://www.linkedin.com/jobs/search/", keywords=need(keyword, "keyword"), location=need(location, "location"), f_TPR=coded, f_E=codes(experience, V.EXPERIENCE_CODES, "experience_levels"), f_WT=codes(workplace, V.WORKPLACE_CODES, "workplace_types"))
    return F.replace(url, F.lit("%2C"), F.lit(","))
