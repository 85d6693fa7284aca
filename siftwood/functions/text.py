"""Text functions as Columns: normal forms, whole-term tests, keep-first lists and merge picks."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented Latin letters and what they are without accents.
ACCENTED = "áàâäãåāăąéèêëēĕėęěíìîïĩīĭįóòôöõōŏőúùûüũūŭůűųñńņňçćĉċčýÿŷśŝşšžźżďťřŕģğĝġĥĵķĺļľŵ"
PLAIN = "aaaaaaaaaeeeeeeeeeiiiiiiiioooooooouuuuuuuuuunnnncccccyyysssszzzdtrrgggghjklllw"

Text = Column | str


def col(c: Text) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text(c: Text) -> Column:
    """Missing text is empty text."""
    return F.coalesce(col(c), F.lit(""))


def let(value: Column, then) -> Column:
    """then(value) with the value worked out once a row, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def clean(c: Text) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(text(c), r"(?U)\s+", " "))


def norm_soft(c: Text) -> Column:
    """Clean and case-folded; accents stay."""
    return F.replace(F.lower(clean(c)), F.lit("ß"), F.lit("ss"))


def norm_key(c: Text) -> Column:
    """Clean, case-folded and without accents (Latin letters)."""
    return F.translate(norm_soft(c), ACCENTED, PLAIN)


def heading_key(c: Text) -> Column:
    """Without accents, lower case, no blanks or colons at the ends; inner white space stays."""
    return F.btrim(F.translate(F.lower(text(c)), ACCENTED, PLAIN), F.lit(" :"))


def joined(*parts: Text) -> Column:
    return F.concat_ws(" ", *(text(p) for p in parts))


def term_pattern(term: str) -> str:
    """Whole-term pattern with ASCII letter and digit borders, for terms like c# or .net too."""
    return r"(?<![a-z0-9])" + re.sub(r"([^\w\s])", r"\\\1", term) + r"(?![a-z0-9])"


def quoted(value: str) -> str:
    """A string as a SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def term_test(name: str, term: str) -> str:
    """Whole-term test of a named column as SQL: long term lists are parsed in one call, where each Column call is a round trip of its own."""
    # the plain search is cheap and settles most rows before the pattern runs
    return f"(contains(`{name}`, {quoted(term)}) AND `{name}` RLIKE {quoted(term_pattern(term))})"


def has_term(c: Text, term: str) -> Column:
    return F.expr(term_test(c, term)) if isinstance(c, str) else c.contains(term) & c.rlike(term_pattern(term))


def has_any_term(c: Text, terms) -> Column:
    if isinstance(c, str) and terms:
        return F.expr(" OR ".join(term_test(c, t) for t in terms))
    out = F.lit(False)
    for t in terms:
        out = out | has_term(c, t)
    return out


def term_hits(c: Text, terms) -> Column:
    """The terms that a normalised text holds, in their order."""
    if not terms:
        return F.array().cast("array<string>")
    if isinstance(c, str):
        return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {term_test(c, t)} THEN {quoted(t)} END" for t in terms) + "))")
    return let(c, lambda x: F.array_compact(F.array(*(F.when(has_term(x, t), F.lit(t)) for t in terms))))


def contains_any(c: Text, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | col(c).contains(p)
    return out


def first_label(c: Text, labels, default: str | None = None) -> Column:
    """Label of the first rule of which the text contains a term."""
    out = F.lit(default).cast("string")
    for label, terms in reversed(tuple(labels)):
        out = F.when(contains_any(c, terms), F.lit(label)).otherwise(out)
    return out


def first_non_empty(*parts: Text) -> Column:
    return F.coalesce(*(F.nullif(F.trim(text(p)), F.lit("")) for p in parts), F.lit(""))


def pick_longer(old: Text, new: Text) -> Column:
    """The longer text; the old one if equally long."""
    return F.when(F.length(text(old)) >= F.length(text(new)), text(old)).otherwise(text(new))


def pick_known(old: Text, new: Text, unknown: str = "unknown") -> Column:
    """A known value beats an unknown one; the old one beats the new."""
    is_known = lambda c: (text(c) != "") & (text(c) != unknown)
    return F.when(is_known(old), col(old)).when(is_known(new), col(new)).otherwise(F.lit(unknown))


def append_line(notes: Text, line: Text) -> Column:
    """Notes with a line more, unless they hold it already."""
    n, x = F.trim(text(notes)), F.trim(text(line))
    return F.when(x == "", n).when(n == "", x).when(n.contains(x), n).otherwise(F.concat(n, F.lit("\n"), x))


def keep_first(a: Text) -> Column:
    """Distinct items in order of first appearance."""
    return F.array_distinct(col(a))


def keep_first_ci(a: Text) -> Column:
    """Trimmed, non-empty items, the first of each that differ in case only."""
    items = F.filter(F.transform(col(a), lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    keys = F.transform(items, lambda x: F.lower(x))
    return F.filter(items, lambda x, i: F.array_position(keys, F.lower(x)) == i + 1)


def pretty(c: Text, names: dict[str, str]) -> Column:
    """Display form: from the names, else each run of letters with a capital."""
    if not names:
        return F.initcap(col(c))
    table = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    spaced = F.regexp_replace(F.initcap(F.regexp_replace(col(c), r"([^\pL\s]+)", "$1\u0001 ")), "\u0001 ", "")
    return F.coalesce(F.try_element_at(table, col(c)), spaced)


def repair_mojibake(c: Text) -> Column:
    """UTF-8 that was read as Latin-1, read again, where that helps."""
    # only characters below 256 can have come from such a reading
    broken = col(c).rlike("[ÃÂâ]") & ~col(c).rlike("[^\\x00-\\xFF]")
    fixed = F.try_validate_utf8(F.encode(F.when(broken, col(c)), "ISO-8859-1").cast("string"))
    return F.when(broken & fixed.isNotNull(), fixed).otherwise(col(c))


def slug(c: Text, default: str = "cv") -> Column:
    """Lower-case ASCII letters and digits joined by single hyphens."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.lower(text(c)), r"[^a-z0-9]+", "-"), F.lit("-")), F.lit("")), F.lit(default))


def safe_name(c: Text) -> Column:
    return F.array_join(F.regexp_extract_all(text(c), F.lit(r"[\pL\pN]+"), 0), "_")


def sentence(c: Text) -> Column:
    """With exactly one full stop at the end; empty stays empty."""
    t = F.rtrim(F.trim(text(c)), F.lit(" ."))
    return F.when(t == "", t).otherwise(F.concat(t, F.lit(".")))


def split_list(c: Text) -> Column:
    """Items of a list written with commas, semicolons or slashes."""
    return F.filter(F.transform(F.split(text(c), "[,;/]"), lambda x: F.trim(x)), lambda x: x != "")


def strip_connectors(c: Text, connectors) -> Column:
    """Without function words at the end."""
    return F.regexp_replace(F.trim(text(c)), r"(?i)(?:[\s,;.]+(?:" + "|".join(connectors) + r"))+[\s,;.]*$", "")


def cap_words(c: Text, most: int, connectors=()) -> Column:
    words = F.filter(F.split(text(c), r"\s+"), lambda x: x != "")
    short = F.array_join(F.slice(words, 1, most), " ")
    return strip_connectors(short, connectors) if connectors else short


def tokens(c: Text, pattern: str = r"[a-z0-9+#.-]+") -> Column:
    return F.array_distinct(F.regexp_extract_all(norm_key(c), F.lit(pattern), 0))


def shared_tokens(profile: Text, offer: Text, stop=()) -> Column:
    """Number of distinct profile tokens (three characters or more) that occur anywhere in a text; both normalised."""
    found = F.array_distinct(F.regexp_extract_all(col(profile), F.lit(r"[a-z0-9.+#-]{3,}"), 0))
    kept = F.array_except(found, F.array(*(F.lit(s) for s in stop))) if stop else found
    # the text is bound first: else its normal form would be worked out for every token
    return let(col(offer), lambda x: F.size(F.filter(kept, lambda t: F.contains(x, t))))


def json_list(c: Text) -> Column:
    """A list stored as JSON text; a JSON string or plain text becomes a list of one, nothing an empty list."""
    t = F.trim(text(c))
    as_list = F.from_json(t, "array<string>")
    as_string = F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"]
    return F.when(t == "", F.array().cast("array<string>")).when(t.startswith("["), F.coalesce(as_list, F.array(t))).when(t.startswith('"'), F.array(F.coalesce(as_string, t))).otherwise(F.array(t))


def redacted(message: Text, secret: str) -> Column:
    return F.replace(text(message), F.lit(secret), F.lit("<redacted>")) if secret else text(message)
