"""Keyword scores, relevance for a target, and labels. Rules are parameters; texts are normalised once and reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed_values as V
from ..functions.phrases import among, found_terms, points_of, reasons_of
from ..functions.text import Text, col, contains_any, first_label, has_any_term, joined, keep_first, keep_first_ci, let, norm_key, norm_soft, pretty, quoted, shared_tokens, split_list, term_hits, term_test

NO_TERMS = "cast(array() as array<string>)"


def target_of(role: Text, targets=tuple(V.TITLE_SIGNALS)) -> Column:
    """Name of a target as it is written with blanks or underscores; NULL if there is none such."""
    name = F.replace(norm_key(role), F.lit(" "), F.lit("_"))
    odd = {t.replace("soporte_", "soporte_de_"): t for t in targets if t.startswith("soporte_")}
    table = F.create_map(*(F.lit(x) for t in targets for x in (t, t)), *(F.lit(x) for kv in odd.items() for x in kv))
    return F.try_element_at(table, name)


def point_sum(text: Text, rules) -> Column:
    """Sum of the points of all (term, points, ...) rules whose term the text holds; overlapping terms count each."""
    if isinstance(text, str) and rules:
        return F.expr(" + ".join(f"CASE WHEN {term_test(text, term)} THEN {int(points)} ELSE 0 END" for term, points, *_ in rules))
    out = F.lit(0)
    for term, points, *_ in rules:
        out = out + F.when(has_any_term(text, [term]), points).otherwise(0)
    return out


def point_reasons(text: Text, rules) -> Column:
    if isinstance(text, str) and rules:
        return F.expr("array_compact(array(" + ", ".join(f"CASE WHEN {term_test(text, term)} THEN {quoted(reason)} END" for term, _, reason in rules) + "))")
    return F.array_compact(F.array(*(F.when(has_any_term(text, [term]), F.lit(reason)) for term, _, reason in rules)))


def with_match(offers: DataFrame, profile: DataFrame | None = None, entry=V.ENTRY_POINTS, penalties=V.PENALTY_POINTS, keywords=V.SCORE_KEYWORDS) -> DataFrame:
    """offers with score (0 to 100) and reasons.

    Base points, plus entry and penalty points, plus points for the keywords of each active target up to a cap, plus points
    for skills shared with the profile (one row of skills, summary, target_roles) up to a cap. Active are the profile's targets and those
    whose keywords the text holds, in order, else a default. Reasons keep the first of each that differ in case only.
    """
    text = norm_key(joined("title", "description", "requirements", "location", "modality"))
    rows = offers.withColumn("__text", text)
    if profile is not None:
        one = profile.limit(1).select(
            norm_key(joined("skills", "summary", "target_roles")).alias("__profile"),
            F.array_compact(F.transform(split_list("target_roles"), lambda r: target_of(r))).alias("__wanted"),
        )
        # one row: a scalar, not a relation that grows
        rows = rows.crossJoin(F.broadcast(one))
    else:
        rows = rows.withColumn("__profile", F.lit(None).cast("string")).withColumn("__wanted", F.expr(NO_TERMS))
    every = [*(term for term, *_ in (*entry, *penalties)), *(term for terms in keywords.values() for term in terms)]
    rows = rows.withColumn("__found", found_terms("__text", every))
    rows = rows.withColumns({f"__hits_{t}": among("__found", terms) for t, terms in keywords.items()})
    inferred = F.array_compact(F.array(*(F.when(F.size(f"__hits_{t}") > 0, F.lit(t)) for t in V.INFERRED_TARGETS)))
    rows = rows.withColumn("__active", keep_first(F.concat("__wanted", inferred)))
    rows = rows.withColumn("__active", F.when(F.size("__active") > 0, F.col("__active")).otherwise(F.array(F.lit(V.DEFAULT_TARGET))))
    hits = F.create_map(*(x for t in keywords for x in (F.lit(t), F.col(f"__hits_{t}"))))
    rows = rows.withColumn("__told", F.filter(F.transform("__active", lambda t: F.struct(t.alias("target"), F.coalesce(F.try_element_at(hits, t), F.expr(NO_TERMS)).alias("terms"))), lambda s: F.size(s["terms"]) > 0))
    target_points = F.aggregate("__told", F.lit(0), lambda a, s: a + F.least(F.lit(V.TARGET_CAP), F.size(s["terms"]) * V.TARGET_POINTS))
    target_reasons = F.transform("__told", lambda s: F.concat(F.lit("Coincide con "), s["target"], F.lit(": "), F.array_join(F.transform(F.slice(s["terms"], 1, 4), lambda t: pretty(t, V.PRETTY)), ", ")))
    shared = F.when(F.col("__profile").isNotNull(), shared_tokens("__profile", "__text", V.SKILL_STOPWORDS)).otherwise(0)
    rows = rows.withColumn("__shared", shared)
    score = F.lit(V.BASE_SCORE) + points_of("__found", entry) + points_of("__found", penalties) + target_points + F.least(F.lit(V.SKILL_CAP), F.col("__shared") * V.SKILL_POINTS)
    reasons = F.concat(reasons_of("__found", entry), reasons_of("__found", penalties), target_reasons, F.when(F.col("__shared") > 0, F.array(F.lit(V.SKILLS_REASON))).otherwise(F.expr(NO_TERMS)))
    rows = rows.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int")).withColumn("reasons", keep_first_ci(reasons))
    rows = rows.withColumn("reasons", F.when(F.size("reasons") > 0, F.col("reasons")).otherwise(F.array(F.lit(V.NO_REASON))))
    return rows.select(*offers.columns, "score", "reasons")


def with_relevance(listings: DataFrame, target: Text, signals_title=V.TITLE_SIGNALS, signals_content=V.CONTENT_SIGNALS) -> DataFrame:
    """listings with relevance: struct(relevant, reasons, keywords) for a target, given as a name or a column.

    In order: unknown target, kept; senior term in the title, rejected; (front end) false friend without a clear signal,
    rejected; administrative title without a technical one, rejected; else the target's own rule: a title hit, or an entry title and
    a content hit, or two content hits (one for infrastructure); full stack needs a title hit or both sides.
    """
    role = target if isinstance(target, Column) else F.lit(target)
    per_target = lambda signals, found: F.create_map(*(x for t, terms in signals.items() for x in (F.lit(t), among(found, terms))))
    rows = listings.withColumns({
        "__target": target_of(role, tuple(signals_title)), "__title": norm_key("title"), "__content": F.trim(F.concat_ws(" ", norm_key("description"), norm_key("requirements"))),
    })
    # normalised parts joined are normalised but for a blank at the ends
    rows = rows.withColumn("__both", F.trim(F.concat_ws(" ", "__title", "__content")))
    none = F.expr(NO_TERMS)
    one = None if isinstance(target, Column) else target.strip().lower().replace(" ", "_").replace("soporte_de_", "soporte_")
    signs = lambda signals: [x for t, terms in signals.items() if one in (None, t) for x in terms]
    if isinstance(target, Column):
        title_hits, content_hits = (F.coalesce(F.try_element_at(per_target(s, t), F.col("__target")), none) for s, t in ((signals_title, "__ftitle"), (signals_content, "__fcontent")))
    else:
        known = one
        title_hits, content_hits = (among(t, s[known]) if known in s else none for s, t in ((signals_title, "__ftitle"), (signals_content, "__fcontent")))
    front_terms = [t for t in dict.fromkeys(signals_title.get("frontend_junior", ()) + signals_content.get("frontend_junior", ())) if t not in V.FRONT_FALSE_FRIENDS]
    rows = rows.withColumns({
        "__ftitle": found_terms("__title", [*V.SENIOR, *V.ENTRY, *V.ADMINISTRATIVE, *V.FRONT_FALSE_FRIENDS, *signs(signals_title)]), "__fcontent": found_terms("__content", [*V.SENIOR, *signs(signals_content)]),
        "__fboth": found_terms("__both", [*V.FULLSTACK_FRONT, *V.FULLSTACK_BACK, *front_terms]),
    })
    rows = rows.withColumns({
        "__senior": among("__ftitle", V.SENIOR), "__entry": among("__ftitle", V.ENTRY), "__csenior": among("__fcontent", V.SENIOR),
        "__admin": among("__ftitle", V.ADMINISTRATIVE), "__friend": F.when(F.col("__target") == "frontend_junior", among("__ftitle", V.FRONT_FALSE_FRIENDS)).otherwise(none),
        "__front": among("__fboth", V.FULLSTACK_FRONT), "__back": among("__fboth", V.FULLSTACK_BACK), "__clear": F.size(among("__fboth", front_terms)) > 0, "__t": title_hits, "__c": content_hits,
    })
    n = lambda c: F.size(c)
    full = F.col("__target") == "fullstack_junior"
    least = F.when(F.col("__target") == "infraestructura_junior", 1).otherwise(2)
    fits = F.when(full, (n("__t") > 0) | ((n("__front") > 0) & (n("__back") > 0))).otherwise((n("__t") > 0) | ((n("__entry") > 0) & (n("__c") > 0)) | (n("__c") >= least))
    signals = keep_first(F.when(full, F.concat("__t", "__front", "__back", "__c")).otherwise(F.concat("__t", "__c")))
    rows = rows.withColumns({"__fits": fits, "__signals": signals})
    seen = F.concat("__entry", "__csenior", "__t", "__c", "__admin", "__friend")
    first = lambda c: F.try_element_at(F.col(c), F.lit(1))
    second = F.concat(F.lit("description menciona "), first("__csenior"))
    annotated = (
        F.when(n("__entry") > 0, F.concat(second, F.lit(" pero title es "), first("__entry"), F.lit("; penalizado, no descartado")))
        .when(n("__t") > 0, F.concat(second, F.lit(" pero title es tecnico ("), first("__t"), F.lit("); penalizado, no descartado")))
        .otherwise(F.concat(second, F.lit("; no se descarta solo por texto secundario")))
    )
    accepted = keep_first_ci(F.array_compact(F.array(
        F.when(n("__entry") > 0, F.concat(F.lit("title indica perfil de entrada: "), first("__entry"))), F.when(n("__csenior") > 0, annotated),
        F.concat(F.lit("coincide con "), F.col("__target"), F.lit(": "), first("__signals")),
    )))
    verdict = lambda ok, reasons, keywords: F.struct(F.lit(ok).alias("relevant"), reasons.alias("reasons"), keep_first(keywords).alias("keywords"))
    relevance = (
        F.when(F.col("__target").isNull(), verdict(True, F.array(F.lit("Sin reglas especificas para el target; se conserva para revision")), none))
        .when(n("__senior") > 0, verdict(False, F.array(F.concat(F.lit("title contiene "), first("__senior"))), F.col("__senior")))
        .when((n("__friend") > 0) & ~F.col("__clear"), verdict(False, F.array(F.concat(first("__friend"), F.lit(" no es frontend tecnico"))), seen))
        .when((n("__admin") > 0) & (n("__t") == 0), verdict(False, F.array(F.lit("cargo administrativo/no tecnico")), seen))
        .when(~F.col("__fits"), verdict(False, F.array(F.lit("no tiene seniales tecnicas suficientes para target")), F.concat(seen, F.col("__signals"))))
        .otherwise(verdict(True, accepted, F.concat(seen, F.col("__signals"))))
    )
    # a generator, as filters on its result are not pushed below it: they would work all the rules out again
    return rows.select(*listings.columns, F.explode(F.array(relevance)).alias("relevance"))


def inferred_target(*parts: Text, labels=V.TARGET_LABELS, default: str = V.DEFAULT_TARGET) -> Column:
    """First target whose words a listing's text contains."""
    return first_label(norm_soft(joined(*parts)), labels, default)


def modality(*parts: Text) -> Column:
    return F.coalesce(first_label(norm_soft(joined(*parts)), V.MODALITIES), F.lit(""))


def weighted_hits(text: Text, target_terms, offer_terms) -> Column:
    """Two points for each target term and one for each offer term that a normalised text contains anywhere."""
    count = lambda terms: sum((F.when(col(text).contains(t), 1).otherwise(0) for t in terms), F.lit(0)) if not isinstance(terms, Column) else F.size(F.filter(terms, lambda t: F.contains(col(text), t)))
    return 2 * count(target_terms) + count(offer_terms)


def technologies(text: Text, known=V.TECHNOLOGIES) -> Column:
    """Names of the known technologies that a text mentions, in the dictionary's order."""
    return let(norm_key(text), lambda t: F.array_compact(F.array(*(F.when(t.rlike(p), F.lit(name)) for name, p in known))))


def offer_keywords(text: Text, stop=V.TOKEN_STOPWORDS, short=V.SHORT_TOKENS) -> Column:
    """Ranking words of a listing: its tokens of three characters or more (or known short ones) without stop words, then the technologies it names."""
    found = F.array_distinct(F.regexp_extract_all(norm_key(text), F.lit(r"[a-z0-9+#.]+"), 0))
    kept = F.filter(found, lambda t: ~t.isin(*stop) & ((F.length(t) >= 3) | t.isin(*short)))
    return keep_first(F.concat(kept, F.transform(technologies(text), lambda t: F.lower(t))))


def application_type(text: Text, easy: tuple[str, ...], external: tuple[str, ...]) -> Column:
    t = norm_key(text)
    return F.when(contains_any(t, easy), V.EASY_APPLY).when(contains_any(t, external), V.EXTERNAL_APPLY).otherwise(V.UNKNOWN_APPLY)


def message_focus(text: Text, templates: dict[str, str], default: str) -> Column:
    """Sentence of the first role that a text contains."""
    return first_label(norm_soft(text), tuple((sentence, (role,)) for role, sentence in templates.items()), templates[default])
