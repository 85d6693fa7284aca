"""Canonical URLs and their hashes as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import TRACKING_PARAMS
from .text import Text, col, text


def _encoded(part: Column) -> Column:
    """A query part decoded and written the form way (blank as +); what can't be decoded stays."""
    plain = F.coalesce(F.try_url_decode(part), part)
    # only characters that the form encoding would change need the detour
    return F.when(part.rlike(r"^[A-Za-z0-9_.~-]*$"), part).otherwise(F.replace(F.replace(F.url_encode(plain), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~")))


def canonical_url(url: Text, tracking=TRACKING_PARAMS) -> Column:
    """Without fragment, tracking parameters and slashes at the end of the path; the scheme in lower case; order and blank values stay."""
    u = F.split(text(url), "#", 2)[0]
    query = F.when(u.contains("?"), F.substring_index(F.regexp_replace(u, r"^[^?]*\?", "\u0001"), "\u0001", -1)).otherwise("")
    base = F.split(u, r"\?", 2)[0]
    scheme = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1)
    base = F.when(scheme != "", F.concat(F.lower(scheme), base.substr(F.length(scheme) + 1, F.length(base)))).otherwise(base)
    host = F.regexp_extract(base, r"^((?:[a-z][a-z0-9+.-]*:)?(?://[^/]*)?)", 1)
    path = base.substr(F.length(host) + 1, F.length(base))
    bare = F.rtrim(path, F.lit("/"))
    path = F.when(bare != "", bare).when(path != "", path).otherwise("/")
    drop = F.array(*(F.lit(t) for t in tracking))
    name = lambda p: F.split(p, "=", 2)[0]
    value = lambda p: F.when(p.contains("="), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    parts = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.array_contains(drop, F.lower(F.coalesce(F.try_url_decode(name(p)), name(p)))))
    kept = F.transform(parts, lambda p: F.concat(_encoded(name(p)), F.lit("="), _encoded(value(p))))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def url_hash(url: Text) -> Column:
    return F.sha2(col(url), 256)


def host(url: Text) -> Column:
    return F.lower(F.regexp_extract(text(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def query_param(url: Text, name: str) -> Column:
    """Raw value of a query parameter, '' without it."""
    return F.regexp_extract(F.split(text(url), "#", 2)[0], rf"[?&]{name}=([^&]*)", 1)


def clean_id(value: Text, pattern: str = r"^[A-Za-z0-9]{8,32}$") -> Column:
    v = F.trim(text(value))
    return F.when(v.rlike(pattern), v).otherwise("")


def listing_id(url: Text, host_suffix: str, paths=("/viewjob", "/rc/clk", "/pagead/clk"), param: str = "jk") -> Column:
    """Id in the query of a listing page of a host, else ''."""
    ok = host(url).rlike(rf"(^|\.){host_suffix.replace('.', chr(92) + '.')}$") & F.regexp_extract(text(url), r"^[^:]+://[^/?#]*([^?#]*)", 1).isin(*paths)
    return F.when(ok, clean_id(query_param(url, param))).otherwise("")


def id_url(identifier: Text, prefix: str) -> Column:
    """Canonical address of a listing id, '' without one."""
    return F.when(text(identifier) == "", "").otherwise(F.concat(F.lit(prefix), col(identifier)))


def absolute_url(base: Text, url: Text) -> Column:
    """url seen from base: absolute, protocol-relative, rooted, query, fragment or plain relative (dot segments stay)."""
    u, b = text(url), text(base)
    scheme = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1)
    root = F.regexp_extract(b, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    page = F.regexp_extract(b, r"^([^?#]*)", 1)
    folder = F.when(page.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/]*$"), F.concat(page, F.lit("/"))).otherwise(F.regexp_replace(page, r"[^/]*$", ""))
    return (
        F.when(u == "", b).when(u.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), u).when(u.startswith("//"), F.concat(scheme, u)).when(u.startswith("/"), F.concat(root, u))
        .when(u.startswith("?"), F.concat(page, u)).when(u.startswith("#"), F.concat(F.regexp_extract(b, r"^([^#]*)", 1), u)).otherwise(F.concat(folder, u))
    )


def with_https(url: Text, on_host: str | None = None) -> Column:
    """http turned into https, everywhere or on one host."""
    changed = F.regexp_replace(text(url), "^http://", "https://")
    return changed if on_host is None else F.when(host(url).endswith(on_host), changed).otherwise(text(url))


def tidy_url(url: Text) -> Column:
    """Without blanks and closing punctuation; https where no scheme is given."""
    u = F.rtrim(F.regexp_replace(text(url), r"\s+", ""), F.lit(".,;)"))
    return F.when((u == "") | u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://"), u))


def first_url_with(urls: Text, part: str) -> Column:
    return F.coalesce(F.try_element_at(F.filter(col(urls), lambda u: F.lower(u).contains(part)), F.lit(1)), F.lit(""))


def first_url_without(urls: Text, *parts: str) -> Column:
    def other(u: Column) -> Column:
        out = F.lit(True)
        for p in parts:
            out = out & ~F.lower(u).contains(p)
        return out

    return F.coalesce(F.try_element_at(F.filter(col(urls), other), F.lit(1)), F.lit(""))


def search_url(prefix: str, **filters: Text) -> Column:
    """prefix with encoded parameters (blank as %20), empty ones left out."""
    enc = lambda c: F.replace(F.url_encode(text(c)), F.lit("+"), F.lit("%20"))
    parts = F.array_compact(F.array(*(F.when(text(c) != "", F.concat(F.lit(f"{k}="), enc(c))) for k, c in filters.items())))
    return F.concat(F.lit(prefix), F.when(F.size(parts) > 0, F.concat(F.lit("?"), F.array_join(parts, "&"))).otherwise(""))


def filter_codes(values: Text, codes: dict[str, str], label: str) -> Column:
    """Codes of named filter values, distinct in order; an unknown name raises an error."""
    table = F.create_map(*(F.lit(x) for kv in codes.items() for x in kv))
    names = F.transform(col(values), lambda v: F.lower(F.trim(v)))
    return F.array_distinct(F.transform(names, lambda v: F.coalesce(F.try_element_at(table, v), F.raise_error(F.concat(F.lit(f"unknown {label}: "), v)).cast("string"))))
