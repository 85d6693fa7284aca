"""PII surrogates, by DataFrame functions alone.

Entities are found with one pattern. Each is replaced by a keyed permutation of its own letters and digits: a Feistel
network over the two halves of its canonical form, whose rounds add a SHA-256 key stream within each character's class
(digit, lower, upper, Cyrillic, Greek, hexadecimal, vowel, consonant). A permutation of all strings of one
format is free of collisions, so different entities stay different (collisions() checks it on data) and equal ones stay
equal in every document. Where two permutations could meet (names of the list and others, hexadecimal and other secrets,
public and private addresses) each walks on until it is back among its own. Separators, case, script, country code,
card check digit and the class of an address are kept; names keep title and script, listed given names their gender, and
others their last letter, which says the gender in many languages.
"""

from __future__ import annotations

import functools
import hashlib
import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textkit import free_name

# What the patterns of entities are. Groups are repeated a bounded number of times, as the engine matches each repetition one call deeper:
# an e-mail has a local part of at most 64 characters, and 127 labels of at most 63 after the first; a name has at most five titles and nine parts in a word.
# Of longer domains and rows of titles the first so many are an entity, and what follows is read anew; longer local parts and words are none.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Mx", "Dr", "Prof", "Professor", "Doctor", "Sir", "Herr", "Frau", "Señor", "Señora", "Madame", "Mme", "Monsieur", "Господин", "Госпожа")
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# a name's word: parts that each begin with a capital, joined by hyphens, apostrophes or nothing (Jean-Pierre, O'Brien, McDonald)
_WORD = r"\p{Lu}(?:\p{Ll}++|['’]\p{Lu}\p{Ll}++)(?:['’-]?\p{Lu}\p{Ll}++){0,8}"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,127}",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key)\b ?[=:] ?\"?)[A-Za-z0-9+/_-]{8,}+|\bAKIA[0-9A-Z]{16}\b",
    "ip": rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "phone": r"(?<![\w.+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\w.])\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-])",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w.-])(?:\d{4}[ -]?){3}\d{4}(?![\w-])|(?<![\w.-])3[47]\d{2}[ -]?\d{6}[ -]?\d{5}(?![\w-])",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "name": rf"(?<!\pL)(?:{'|'.join(TITLES)})\.? (?:(?:{'|'.join(TITLES)})\.? ){{0,4}}{_WORD}(?: {_WORD})?(?!\pL)",
}
# Given names by script and gender; a given name is replaced by another of its list.
GIVEN = {
    "latin_f": ("Alice", "Beatrice", "Camille", "Charlotte", "Daniela", "Eleanor", "Florence", "Gabriela", "Hannah", "Isabella", "Jessica", "Katharina", "Lucía", "Margaret", "Natalie", "Patricia", "Rebecca", "Sabrina", "Theresa", "Victoria"),
    "latin_m": ("Albert", "Benjamin", "Carlos", "Christian", "Dominik", "Edward", "François", "Gustavo", "Heinrich", "Ignacio", "Jonathan", "Laurent", "Matthew", "Nicolas", "Oliver", "Patrick", "Richard", "Sebastian", "Thomas", "Wolfgang"),
    "cyrillic_f": ("Анастасия", "Валентина", "Екатерина", "Ирина", "Людмила", "Наталья", "Светлана", "Татьяна"),
    "cyrillic_m": ("Алексей", "Владимир", "Дмитрий", "Михаил", "Николай", "Сергей", "Фёдор", "Юрий"),
}
# Classes of characters; a character is only ever replaced within its class.
DIGITS, HEX, LOWER, UPPER = "0123456789", "abcdef", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
VOWELS, CONSONANTS, ACCENTED = "aeiou", "bcdfghjklmnpqrstvwxyz", "áéíóúàèùâêîôûäöüß"
CYRILLIC, GREEK = "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "αβγδεζηθικλμνξοπρστυφχψω"
ROUNDS = 4
# Fixed values: (first address, free bits) of private and reserved ranges, which are permuted each on its own, and addresses that name no host and stay.
RANGES = ((10 << 24, 24), (172 << 24 | 16 << 16, 20), (192 << 24 | 168 << 16, 16), (0, 24), (127 << 24, 24), (169 << 24 | 254 << 16, 16), (224 << 24, 28), (240 << 24, 28))
KEPT = (0, 127 << 24 | 1, (1 << 32) - 1)
#: The setting that names the key of a session, and the key of sessions without one: for trials alone, as anyone can read it here.
KEY_SETTING, TRIAL_KEY = "spark.siftwood.pii.key", "trial"


def key_of(spark) -> str:
    return spark.conf.get(KEY_SETTING, TRIAL_KEY)


def _let(value: Column, then) -> Column:
    """then(value) with the value worked out once, however often then uses it."""
    return F.transform(F.array(value), then)[0]


def may_hold(text: Column) -> Column:
    """Whether a text has what every entity has some of: a digit, an at sign, a mark after a keyword, or a title. Far cheaper than the patterns."""
    out = text.rlike("[0-9@=:]") | text.contains("AKIA")
    for title in TITLES:
        out = out | text.contains(title)
    return out


def any_pattern() -> str:
    return "|".join(f"(?:{p})" for p in PATTERNS.values())


def kind_of(entity: Column) -> Column:
    """Name of the first pattern that a detected entity matches as a whole."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(PATTERNS.items()):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def _shifted(c: Column, by: Column, classes: tuple[str, ...]) -> Column:
    out = c
    for letters in reversed(classes):
        at = F.instr(F.lit(letters), c)
        moved = F.lit(letters).substr(F.pmod(at - 1 + by, F.lit(len(letters))).cast("int") + 1, F.lit(1))
        out = F.when(at > 0, moved).otherwise(out)
    return out


def permuted(text: Column, tweak: Column | str, classes: tuple[str, ...], key: str) -> Column:
    """A keyed permutation of the strings that have text's length and character classes."""
    tweak = F.lit(tweak) if isinstance(tweak, str) else tweak

    def turn(state: Column, i: Column) -> Column:
        stream = F.sha2(F.concat_ws("\x1f", F.lit(key), tweak, i.cast("string"), state["r"]), 256)
        by = lambda s, k: F.conv(s.substr((k * 3) % 60 + 1, F.lit(4)), 16, 10).cast("int")
        moved = _let(stream, lambda s: F.array_join(F.transform(_chars(state["l"]), lambda c, k: _shifted(c, by(s, k), classes)), ""))
        return F.struct(state["r"].alias("l"), moved.alias("r"))

    def halves(t: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        return F.struct(t.substr(F.lit(1), half).alias("l"), t.substr(half + 1, F.length(t)).alias("r"))

    return _let(text, lambda t: F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), halves(t), turn, lambda s: F.concat(s["l"], s["r"])))


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def _refilled(entity: Column, core: Column) -> Column:
    """entity with its letters and digits replaced by those of core, in order, in the case that they had."""
    placed = F.transform(_chars(entity), lambda c, i: F.struct(i.alias("i"), c.alias("c")))
    is_core = lambda x: x["c"].rlike(r"[\pL\pN]")
    new = lambda x, k: F.struct(x["i"].alias("i"), F.when(x["c"].rlike(r"\p{Lu}"), F.upper(k)).otherwise(k).alias("c"))
    # letters and marks apart, and put back by place: no character looks at all those before it
    woven = lambda p: F.concat(F.zip_with(F.filter(p, is_core), _chars(core), new), F.filter(p, lambda x: ~is_core(x)))
    return _let(placed, lambda p: F.array_join(F.transform(F.array_sort(woven(p)), lambda x: x["c"]), ""))


def _core(entity: Column) -> Column:
    return F.regexp_replace(entity, r"[^\pL\pN]", "")


def _luhn(digits: Column) -> Column:
    """Sum that the check digit completes to a multiple of ten, for digits without it."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.when((n - i) % 2 == 0, F.when(digits.substr(i, F.lit(1)).cast("int") > 4, digits.substr(i, F.lit(1)).cast("int") * 2 - 9).otherwise(digits.substr(i, F.lit(1)).cast("int") * 2)).otherwise(digits.substr(i, F.lit(1)).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x)


def _card(e: Column, key: str) -> Column:
    def renumbered(digits: Column) -> Column:
        body = digits.substr(F.lit(1), F.length(digits) - 1)
        new = F.concat(body.substr(F.lit(1), F.lit(1)), permuted(body.substr(F.lit(2), F.length(body)), "card", (DIGITS,), key))
        last = digits.substr(F.length(digits), F.lit(1)).cast("int")
        # a valid number stays valid; an invalid one is off by as much as before
        return _let(new, lambda n: F.concat(n, F.pmod(last + _luhn(body) - _luhn(n), F.lit(10)).cast("string")))

    return _refilled(e, _let(_core(e), renumbered))


def _walked(start: Column, outside, step, most: int) -> Column:
    """step(start), taken on while outside() holds: with a permutation as step, a permutation of what is inside."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(most)), step(start), lambda s, _: F.when(outside(s), step(s)).otherwise(s))


def _ip(e: Column, key: str) -> Column:
    def within(n: Column, first: int, bits: int) -> Column:
        return F.shiftright(n, bits) == first >> bits

    def moved(n: Column, bits: int) -> Column:
        """A permutation of the lowest bits."""
        half = bits // 2
        state = F.struct(F.shiftright(n, half).bitwiseAND(F.lit((1 << half) - 1)).alias("l"), n.bitwiseAND(F.lit((1 << half) - 1)).alias("r"))

        def turn(s: Column, i: Column) -> Column:
            by = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(f"ip{bits}"), i.cast("string"), s["r"].cast("string")), 256), 1, 6), 16, 10).cast("long")
            return F.struct(s["r"].alias("l"), F.pmod(s["l"] + by, F.lit(1 << half)).alias("r"))

        new = F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, turn, lambda s: s["l"] * (1 << half) + s["r"])
        return F.shiftright(n, bits) * (1 << bits) + new

    def renumbered(n: Column) -> Column:
        out = F.when(n.isin(*KEPT), n)
        for first, bits in RANGES:
            out = out.when(within(n, first, bits), _walked(n, lambda s: s.isin(*KEPT), lambda s, bits=bits: moved(s, bits), len(KEPT)))
        # a seventh of all addresses are not public: so many steps are never needed
        elsewhere = lambda s: functools.reduce(lambda x, y: x | y, (within(s, *r) for r in RANGES))
        return out.otherwise(_walked(n, elsewhere, lambda s: moved(s, 32), 48))

    number = F.aggregate(F.split(e, r"\."), F.lit(0).cast("long"), lambda a, o: a * 256 + o.cast("long"))
    return _let(_let(number, renumbered), lambda n: F.concat_ws(".", *(F.shiftright(n, b).bitwiseAND(F.lit(255)).cast("string") for b in (24, 16, 8, 0))))


def _email(e: Column, key: str) -> Column:
    # the top domain stays; upper and lower case are one address
    tail = F.regexp_extract(e, r"(\.[A-Za-z0-9-]+)$", 1)
    head = e.substr(F.lit(1), F.length(e) - F.length(tail))
    return F.concat(_refilled(head, permuted(F.lower(_core(head)), "email", (DIGITS, LOWER), key)), tail)


def _phone(e: Column, key: str) -> Column:
    # the country code stays; separators don't matter, so one number written in two ways stays one number
    head = F.regexp_extract(e, r"^(\+\d{1,3})[ .(-]", 1)
    rest = e.substr(F.length(head) + 1, F.length(e))
    return F.concat(head, _refilled(rest, permuted(_core(rest), "phone", (DIGITS,), key)))


def _secret(e: Column, key: str) -> Column:
    head = F.regexp_extract(e, r"^((?i:(?:password|passwd|pwd|secret|token|api[_-]?key) ?[=:] ?\"?)|AKIA)", 1)
    body = e.substr(F.length(head) + 1, F.length(e))
    is_hex = lambda t: t.rlike("^[0-9a-f]+$")
    other = _walked(body, is_hex, lambda t: permuted(t, "secret", (DIGITS, LOWER, UPPER), key), 16)
    return F.concat(head, F.when(is_hex(body), permuted(body, "hex", (DIGITS, HEX), key)).otherwise(other))


def _given_names(key: str) -> Column:
    """Each given name to the next of its list in an order that the key sets."""
    pairs = []
    for names in GIVEN.values():
        order = sorted(names, key=lambda x: hashlib.sha256(f"{key}\x1f{x}".encode()).digest())
        pairs += [F.lit(x) for pair in zip(order, order[1:] + order[:1], strict=True) for x in pair]
    return F.create_map(*pairs)


def _name(e: Column, key: str) -> Column:
    # (titles )(given )(family); the titles are kept and with it the gender
    head = F.regexp_extract(e, rf"^((?:(?:{'|'.join(TITLES)})\.? ){{1,5}})", 1)
    words = F.split(e.substr(F.length(head) + 1, F.length(e)), " ")
    known = _given_names(key)

    def other(word: Column) -> Column:
        def changed(c: Column) -> Column:
            last = c.substr(F.length(c), F.lit(1))
            return F.concat(permuted(c.substr(F.lit(1), F.length(c) - 1), F.concat(F.lit("name"), last), (VOWELS, CONSONANTS, ACCENTED, CYRILLIC, GREEK), key), last)

        return _refilled(word, _let(F.lower(_core(word)), changed))

    # another name that falls on a listed one goes on to where that one would go, so names as a whole are permuted
    listed = [x for names in GIVEN.values() for x in names]
    walked = lambda w: _walked(w, lambda s: s.isin(listed), other, len(listed))
    return F.concat(head, F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(known, w), walked(w))), " "))


def surrogate(entity: Column, kind: Column, key: str) -> Column:
    """The replacement of a detected entity of a kind."""
    iban = F.upper(_core(entity))
    return (
        F.when(kind == "email", _email(entity, key)).when(kind == "secret", _secret(entity, key)).when(kind == "ip", _ip(entity, key))
        .when(kind == "phone", _phone(entity, key)).when(kind == "ssn", _refilled(entity, permuted(_core(entity), "ssn", (DIGITS,), key)))
        .when(kind == "card", _card(entity, key)).when(kind == "name", _name(entity, key))
        .when(kind == "iban", _refilled(entity, F.concat(iban.substr(1, 2), permuted(iban.substr(F.lit(3), F.length(iban)), "iban", (DIGITS, UPPER), key))))
        .otherwise(entity)
    )


def pseudonymised(docs: DataFrame, key: str, text_col: str = "text", entities_col: str = "__entities") -> DataFrame:
    """docs with text_col rewritten, and entities_col: array of struct(kind, entity, surrogate) in order of place.

    Whoever has the key can undo the surrogates; it belongs in a session's settings (key_of), not in code. Null texts stay
    null with no entities; texts without an entity stay as they are. Each row stands for itself, so repeated rows change
    alike; an empty table stays empty. All other columns are kept; only one that is named as entities_col gives way to it.
    """
    text, held = F.col(text_col), free_name(docs, "found")
    found = F.when(may_hold(text), F.regexp_extract_all(text, F.lit(any_pattern()), 0)).otherwise(F.array().cast("array<string>"))
    told = F.transform(F.col(held), lambda e: _let(kind_of(e), lambda k: F.struct(k.alias("kind"), e.alias("entity"), surrogate(e, k, key).alias("surrogate"))))
    gaps = F.split(text, any_pattern(), -1)
    woven = F.array_join(F.zip_with(gaps, F.concat(F.col(entities_col)["surrogate"], F.array(F.lit(""))), lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    # found and replaced in columns of their own: each expression is evaluated once a row
    out = docs.withColumn(held, found).withColumn(entities_col, F.when(F.size(held) > 0, told).otherwise(F.expr("cast(array() as array<struct<kind:string,entity:string,surrogate:string>>)")))
    return out.withColumn(text_col, F.when(F.size(held) > 0, woven).otherwise(text)).drop(held)


def collisions(replaced: DataFrame, entities_col: str = "__entities") -> DataFrame:
    """(kind, surrogate, entities): surrogates that more than one entity of a kind was given; empty unless distinctness broke.

    Entities are compared in canonical form: letters and digits alone, e-mail addresses without case, phone numbers without separators.
    """
    each = replaced.select(F.explode(entities_col).alias("e")).select("e.*").distinct()
    canon = lambda c: F.when(F.col("kind") == "email", F.lower(c)).when(F.col("kind").isin("phone", "card", "iban", "ssn"), _core(c)).otherwise(c)
    rows = each.select("kind", canon(F.col("surrogate")).alias("surrogate"), canon(F.col("entity")).alias("entity")).distinct()
    return rows.groupBy("kind", "surrogate").agg(F.count("*").alias("entities")).where("entities > 1")


def checked(replaced: DataFrame, entities_col: str = "__entities") -> DataFrame:
    """replaced as it is, after a pass over all its entities that warns of the kinds in which different ones became equal."""
    found = collisions(replaced, entities_col).groupBy("kind").count().collect()
    if found:
        warnings.warn("equal surrogates of different entities: " + ", ".join(f"{r['kind']} {r['count']}" for r in sorted(found)), stacklevel=2)
    return replaced
