"""Listing pages to rows. Simple tags are read natively; CSS selectors run in Arrow batches on the standard HTML parser."""

from __future__ import annotations

import re
import unicodedata
from html.parser import HTMLParser
from urllib.parse import parse_qs, urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.dates import published
from ..functions.text import clean, col, contains_any, let, norm_soft, text
from ..functions.urls import absolute_url, canonical_url
from ..operators.scoring import modality
from ..shared import small_batches
from ..shipping import ship_package

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


# ------------------------------------------------------------------ native

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescaped(c: Column) -> Column:
    for entity, plain in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(plain))
    return c


def plain_references(html: Column | str) -> Column:
    """HTML in which these entities alone, each with its semicolon, are references; any other ampersand becomes one, so that parsers which read more show it as it is."""
    known = "|".join(entity[1:] for entity, _ in ENTITIES)
    return F.regexp_replace(text(html), f"&(?!{known})", "&amp;")


def visible_text(html: Column | str) -> Column:
    """Text of a page or part: scripts and styles out, tags to blanks, entities resolved, clean."""
    t = F.regexp_replace(text(html), r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    return clean(unescaped(F.regexp_replace(t, r"(?s)<[^>]*>", " ")))


def tag_text(html: Column | str, tag: str) -> Column:
    """Text of the first element of a tag; ''."""
    return visible_text(F.regexp_extract(text(html), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))


def first_tag_text(html: Column | str, *tags: str) -> Column:
    """Text of the first of these tags that has any."""
    return F.coalesce(*(F.nullif(tag_text(html, t), F.lit("")) for t in tags), F.lit(""))


def links(html: Column | str, inside: str = "") -> Column:
    """Array of struct(href, text) of the anchors in order, only those right inside a tag if one is named."""
    lead = rf"<{inside}\b[^>]*>\s*" if inside else ""
    found = F.regexp_extract_all(text(html), F.lit(rf"(?is){lead}(<a\b[^>]*>.*?</a\s*>)"), 1)
    href = lambda a: unescaped(F.regexp_extract(a, r"""(?is)^<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']""", 1))
    return F.transform(found, lambda a: F.struct(href(a).alias("href"), visible_text(a).alias("text")))


def json_ld(html: Column | str) -> Column:
    """Bodies of the JSON-LD scripts."""
    return F.regexp_extract_all(text(html), F.lit(r"""(?is)<script\b[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script\s*>"""), 1)


def job_posting(html: Column | str) -> Column:
    """First JobPosting among the JSON-LD of a page (an object, a list or @graph), as JSON text; NULL without one."""
    bodies = F.transform(json_ld(html), lambda b: F.trim(b))
    as_list = lambda b: F.when(b.startswith("["), F.from_json(b, "array<string>")).otherwise(F.coalesce(F.from_json(F.get_json_object(b, "$.@graph"), "array<string>"), F.array(b)))
    nodes = F.flatten(F.transform(bodies, lambda b: F.coalesce(as_list(b), F.expr("cast(array() as array<string>)"))))
    kind = lambda n: F.get_json_object(n, "$.@type")
    return F.try_element_at(F.filter(nodes, lambda n: (kind(n) == "JobPosting") | kind(n).contains('"JobPosting"')), F.lit(1))


def posting_fields(posting: Column) -> Column:
    """struct(title, company, location, salary, description, published) of a JobPosting."""
    get = lambda path: F.coalesce(F.get_json_object(posting, path), F.lit(""))
    parts = F.filter(F.array(*(F.trim(get(f"$.jobLocation.address.{k}")) for k in ("addressLocality", "addressRegion", "addressCountry"))), lambda x: x != "")
    lows = F.transform(parts, lambda x: F.lower(x))
    place = F.array_join(F.filter(parts, lambda x, i: F.array_position(lows, F.lower(x)) == i + 1), ", ")
    amount = F.coalesce(F.get_json_object(posting, "$.baseSalary.value.value"), F.when(~F.get_json_object(posting, "$.baseSalary.value").startswith("{"), F.get_json_object(posting, "$.baseSalary.value")))
    salary = F.trim(F.concat_ws(" ", F.get_json_object(posting, "$.baseSalary.currency"), amount))
    return F.struct(clean(get("$.title")).alias("title"), clean(get("$.hiringOrganization.name")).alias("company"), place.alias("location"), F.when(amount.isNull(), "").otherwise(salary).alias("salary"), visible_text(unescaped(get("$.description"))).alias("description"), get("$.datePosted").alias("published"))


def block_reason(html: Column | str, status: Column | None = None, has_cards: Column | None = None) -> Column:
    """Why a page shows no listings: status, captcha or challenge signs, or a login wall; NULL if nothing speaks against it.

    Widgets and challenge marks do not count where the page has listing cards.
    """
    cards = F.coalesce(has_cards, F.lit(False)) if has_cards is not None else F.lit(False)
    widgets = ((r"<iframe[^>]*recaptcha", "iframe recaptcha visible"), (r'class="[^"]*g-recaptcha', "widget recaptcha visible"), (r'class="[^"]*cf-turnstile|<iframe[^>]*turnstile', "turnstile visible"), (r"<form[^>]*action=[^>]*captcha", "formulario captcha visible"), (r"<input[^>]*name=[^>]*captcha", "input captcha visible"), (r'id="(?:cf-)?challenge-running"', "challenge visible"))

    def told(seen: Column, raw: Column) -> Column:
        out = F.when(contains_any(seen, V.LOGIN_TEXTS), "login requerido detectado en el contenido")
        out = F.when(contains_any(raw, V.CHALLENGE_MARKS) & ~cards, "cloudflare challenge embebido").otherwise(out)
        for pattern, reason in reversed(widgets):
            out = F.when(raw.rlike(pattern) & ~cards, reason).otherwise(out)
        for token, reason in reversed(V.BLOCK_TEXTS):
            out = F.when(seen.contains(token), reason).otherwise(out)
        return out

    # both forms of the page are worked out once
    out = let(norm_soft(visible_text(html)), lambda seen: let(norm_soft(html), lambda raw: told(seen, raw)))
    if status is not None:
        out = F.when(status == 403, "status 403").when(status == 429, "status 429").otherwise(out)
    return out


# ------------------------------------------------------------------ selectors


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict, parent):
        self.tag, self.attrs, self.children, self.parent = tag, attrs, [], parent

    def walk(self):
        todo = [c for c in reversed(self.children) if isinstance(c, Node)]
        while todo:
            n = todo.pop()
            yield n
            todo += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self) -> str:
        out, todo = [], [self]
        while todo:
            n = todo.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in ("script", "style"):
                todo += reversed(n.children)
        return re.sub(r"\s+", " ", " ".join(out)).strip()


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag):
        n = self.at
        while n is not None and n.tag != tag:
            n = n.parent
        if n is not None and n.parent is not None:
            self.at = n.parent

    def handle_data(self, data):
        self.at.children.append(data)


_PART = re.compile(r"""(?P<tag>^[a-zA-Z][\w-]*)|\.(?P<cls>[\w-]+)|\#(?P<id>[\w-]+)|\[(?P<attr>[\w-]+)(?:(?P<op>[*^$]?=)['"]?(?P<val>[^'"\]]*)['"]?)?\]""")


def _simple(selector: str):
    tests = [m.groupdict() for m in _PART.finditer(selector)]

    def ok(n: Node) -> bool:
        for t in tests:
            if t["tag"] and n.tag != t["tag"]:
                return False
            if t["cls"] and t["cls"] not in n.attrs.get("class", "").split():
                return False
            if t["id"] and n.attrs.get("id") != t["id"]:
                return False
            if t["attr"]:
                v = n.attrs.get(t["attr"])
                if v is None or (t["op"] and not {"=": v == t["val"], "*=": t["val"] in v, "^=": v.startswith(t["val"]), "$=": v.endswith(t["val"])}[t["op"]]):
                    return False
        return True

    return ok


def select(node: Node, selector: str) -> list[Node]:
    """Descendants in order that match one of 'part part ..., part ...', each part a tag, .class, #id or [attr op value] or several of them."""
    ways = [[_simple(p) for p in one.split()] for one in selector.split(",")]

    def ok(n: Node, parts) -> bool:
        if not parts[-1](n):
            return False
        up, k = n.parent, len(parts) - 2
        while k >= 0 and up is not None:
            if parts[k](up):
                k -= 1
            up = up.parent
        return k < 0

    return [n for n in node.walk() if any(ok(n, parts) for parts in ways)]


def tree(html: str) -> Node:
    parser = _Tree()
    parser.feed(html or "")
    parser.close()
    return parser.root


FIELDS = ("title", "company", "location", "posted", "salary", "description", "requirements")
JK = re.compile("[A-Za-z0-9]{8,32}")


def first_text(node: Node, selectors) -> str:
    return next((t for s in selectors for n in select(node, s)[:1] if (t := n.text())), "")


def _job_key(card: Node) -> str:
    """The job key of a card: its own attribute, one inside it, or that of a link; '' without a valid one."""
    said = [n.attrs.get("data-jk", "") for n in (card, *select(card, "[data-jk]"))]
    for n in select(card, "a[href]"):
        url = urlsplit(urljoin("https://co.indeed.com", n.attrs["href"]))
        if url.netloc.endswith("indeed.com") and url.path in ("/rc/clk", "/viewjob"):
            said += parse_qs(url.query).get("jk", [])[:1]
    return next((k.strip() for k in said if JK.fullmatch(k.strip())), "")


def _control_text(node: Node) -> str:
    return " ".join(x for x in (node.text(), *(node.attrs.get(a, "") for a in ("aria-label", "title", "data-control-name"))) if x)


def _folded(value: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", " ".join(value.split()).casefold()) if not unicodedata.combining(c))


def application_type_of(node: Node) -> str:
    """How one applies, by what a card or page says and by what its buttons and links say."""
    said = _folded(" ".join([node.text(), *(_control_text(n) for n in select(node, "button, a, [role='button'], [aria-label], [title], [data-control-name]"))]))
    if any(x in said for x in V.EASY_APPLY_SIGNALS):
        return V.EASY_APPLY
    if any(x in said for x in V.EXTERNAL_APPLY_SIGNALS):
        return V.EXTERNAL_APPLY
    for n in select(node, "button, a, [role='button']"):
        control = _folded(_control_text(n))
        # a control that names the action alone, or begins with it, leads elsewhere
        if control and (control in V.APPLY_CONTROLS or control.split(" ")[0] in ("solicitar", "apply")):
            return V.EXTERNAL_APPLY
    return V.UNKNOWN_APPLY


def cards_of(html: str, selectors: dict, rules: dict | None = None) -> list[dict]:
    """Cards of a page: the first card selector that finds any, and for each field the first selector with text.

    Cards without title or link are skipped. rules (portals.RULES) add what a portal needs: words that tell a field's
    text where no selector does, an identity of which the first card is kept, links by that identity, application types.
    """
    root, rules = tree(html), rules or {}
    cards = next((found for s in selectors.get("card", ()) if (found := select(root, s))), [])
    out, seen = [], set()
    for card in cards:
        row = {f: first_text(card, selectors.get(f, ())) for f in FIELDS}
        for f, (tags, words) in rules.get("hints", {}).items():
            if not row[f]:
                row[f] = next((t for n in select(card, ", ".join(tags)) if (t := n.text()) and any(w in t.casefold() for w in words)), "")
        row["href"] = next((h for s in selectors.get("link", ()) for n in select(card, s)[:1] if (h := n.attrs.get("href", "").strip())), "")
        for n in select(card, "a[href]") if rules.get("link_parts") else ():
            if any(part in n.attrs["href"] for part in rules["link_parts"]):
                row["title"], row["href"] = row["title"] or n.text(), row["href"] or n.attrs["href"].strip()
        key = _job_key(card) if rules.get("identity") == "jk" else row["href"].split("?")[0] if rules.get("identity") else None
        if key == "" or (key is not None and key in seen):
            continue
        if key and rules["identity"] == "jk":
            seen.add(key)
        if rules.get("own_link"):
            row["href"] = rules["own_link"].format(key)
        if not (row["title"] and row["href"]):
            continue
        seen.add(key)
        if rules.get("most_description"):
            row["description"] = "" if row["description"] in (row["location"], row["posted"]) else row["description"][: rules["most_description"]]
        row["context"] = card.text() if rules.get("whole_card") else ""
        row["application_type"] = application_type_of(card) if rules.get("application") else V.UNKNOWN_APPLY
        out.append(row)
    if rules.get("application") and out:
        # what the open detail panel says belongs to the first card
        first, said = out[0], first_text(root, ("div.description__text",))
        first["description"] = first["description"] or said
        if first["application_type"] == V.UNKNOWN_APPLY:
            first["application_type"] = panel_application_type(root)
    return out


def panel_application_type(root: Node) -> str:
    kinds = (application_type_of(p) for s in V.DETAIL_PANELS for p in select(root, s)[:1])
    return next((k for k in kinds if k != V.UNKNOWN_APPLY), V.UNKNOWN_APPLY)


CARD = "array<struct<title string, company string, location string, posted string, salary string, description string, requirements string, href string, context string, application_type string>>"


def with_cards(pages: DataFrame, selectors: dict[str, dict], portal: str = "portal", html: str = "html", rules: dict[str, dict] | None = None) -> DataFrame:
    """pages with a row per listing card, parsed by the selectors and rules of the page's portal; pos is its place on the page. Unknown portals give no rows."""
    ship_package(pages.sparkSession)
    small_batches(pages.sparkSession)
    known = rules or {}

    @F.pandas_udf(CARD)
    def extract(portals: pd.Series, htmls: pd.Series) -> pd.Series:
        names = [(p or "").strip().lower() for p in portals]
        return pd.Series([cards_of(h or "", selectors.get(p, {}), known.get(p)) for p, h in zip(names, htmls, strict=True)])

    rows = pages.withColumn("__cards", extract(portal, html))
    kept = [c for c in pages.columns if c != html]
    return rows.select(*kept, F.posexplode("__cards").alias("pos", "__c")).select(*kept, "pos", "__c.*")


def scanned(cards: DataFrame, now: Column, per_source: int, page_url: str = "url", source: str = "source_id") -> DataFrame:
    """Listings of the first so many cards of each source: canonical URL, modality, publication time."""
    url = canonical_url(absolute_url(page_url, "href"))
    if "context" not in cards.columns:
        cards = cards.withColumn("context", F.lit(""))
    w = Window.partitionBy(source).orderBy("pos")
    rows = cards.where((text("title") != "") & (text("href") != "")).withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= per_source).drop("__n")
    return rows.withColumns({"listing_url": url, "modality": modality("location", "description", "requirements", "context"), "published_at": published("posted", now), "found_at": now, "raw_posted_text": F.col("posted")}).drop("href", "posted", "context")


def with_details(listings: DataFrame, details: DataFrame, key: str, fields: tuple[str, ...] = ("title", "company", "location", "salary", "description")) -> DataFrame:
    """Listings with fields of their detail pages' JSON-LD where those have any; a missing or broken detail page leaves the listing as it was."""
    found = details.select(key, posting_fields(job_posting("html")).alias("__d"))
    rows = listings.join(found, key, "left")
    return rows.withColumns({f: F.coalesce(F.nullif(F.col(f"__d.{f}"), F.lit("")), F.col(f)) for f in fields}).drop("__d")


__all__ = ["application_type_of", "block_reason", "cards_of", "clean", "col", "first_tag_text", "job_posting", "json_ld", "links", "plain_references", "posting_fields", "scanned", "select", "tag_text", "tree", "unescaped", "visible_text", "with_cards", "with_details"]
