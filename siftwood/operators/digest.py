"""Digests of offers: ranked, limited, packed into messages of bounded size, and their delivery state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Settings
from ..fixed_values import EASY_APPLY
from ..functions.dates import local_text, publication_text
from ..functions.text import first_non_empty, text
from ..shared import written
from .long_digest import part_numbers, positions
from .scoring import inferred_target

SEPARATOR = "\n\n"


def rank_order(score: str = "compatibility_score", found: str = "found_at", created: str = "created_at", last: str = "url_hash") -> list[Column]:
    """Best score first, then latest, unknown times last; a unique column settles ties."""
    return [F.coalesce(F.col(score), F.lit(0.0)).desc(), F.coalesce(F.col(found), F.col(created)).desc_nulls_last(), F.col(last)]


def top_rows(rows: DataFrame, k: int, order: list[Column], by: str | None = None) -> DataFrame:
    """The first k rows (all if k <= 0), of each group if by names one, with position and overflow (rows left out).

    Groups are cut by a ranked window that Spark limits before its shuffle; counts are aggregated apart. Null is a group.
    """
    if by is None:
        # one list over all rows: a top-k keeps k rows a task before anything is moved
        total = rows.agg(F.count(F.lit(1)).alias("__all"))
        kept = rows.orderBy(*order).limit(k) if k > 0 else rows
        placed = kept.withColumn("position", F.row_number().over(Window.orderBy(*order)))
        return placed.crossJoin(F.broadcast(total)).withColumn("overflow", F.greatest(F.lit(0), F.col("__all") - k) if k > 0 else F.lit(0).cast("long")).drop("__all")
    w = Window.partitionBy(by).orderBy(*order)
    total = rows.groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__all"))
    placed = rows.withColumn("position", F.row_number().over(w))
    placed = placed.where(F.col("position") <= k) if k > 0 else placed
    return placed.join(total, F.col(by).eqNullSafe(F.col("__by"))).withColumn("overflow", F.greatest(F.lit(0), F.col("__all") - k) if k > 0 else F.lit(0).cast("long")).drop("__all", "__by")


def reason_lines(reasons: Column | str) -> Column:
    """Reasons as a list of lines, or a hint to look by hand."""
    items = F.filter(F.transform(F.col(reasons) if isinstance(reasons, str) else reasons, lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")).otherwise("- Revisar manualmente.")


def _shared_lines(settings: Settings) -> tuple[Column, Column]:
    place = F.array_join(F.filter(F.array(text("location"), text("modality")), lambda x: x != ""), " / ")
    easy = F.when(text("application_type") == EASY_APPLY, "Tipo de solicitud: Solicitud sencilla")
    return place, easy


def entry_text(settings: Settings = DEFAULTS, position: str = "position") -> Column:
    """An offer as an entry of a digest."""
    place, easy = _shared_lines(settings)
    label = lambda c, otherwise: first_non_empty(c, F.lit(otherwise))
    return F.concat_ws("\n",
        F.concat(F.col(position).cast("string"), F.lit(". "), text("title")), F.concat(F.lit("Empresa: "), label("company", "No detectada")),
        F.concat(F.lit("Portal: "), label("portal", "No detectado")), easy, F.concat(F.lit("Ubicación: "), label(place, "No detectada")),
        F.concat(F.lit("Compatibilidad: "), F.floor("compatibility_score").cast("string"), F.lit("%")),
        F.concat(F.lit("Publicada: "), publication_text("published_at", "raw_posted_text", settings.timezone)),
        F.concat(F.lit(f"{settings.detected_label}: "), local_text("found_at", settings.timezone)), F.concat(F.lit("Link: "), text("url")),
    )


def alert_text(settings: Settings = DEFAULTS) -> Column:
    """One offer as a message of its own."""
    place, easy = _shared_lines(settings)
    label = lambda c, otherwise: first_non_empty(c, F.lit(otherwise))
    return F.concat_ws("\n",
        F.lit("Nueva oferta fresca recomendada"), F.lit(""), F.concat(F.lit("Cargo: "), text("title")), F.concat(F.lit("Empresa: "), label("company", "No detectada")),
        F.concat(F.lit("Portal: "), label("portal", "No detectado")), easy, F.concat(F.lit("Ubicación: "), label(place, "No detectada")),
        F.concat(F.lit("Publicada: "), publication_text("published_at", "raw_posted_text", settings.timezone)),
        F.concat(F.lit(f"{settings.detected_label}: "), local_text("found_at", settings.timezone)),
        F.concat(F.lit("Compatibilidad: "), F.floor("compatibility_score").cast("string"), F.lit("%")), F.lit(""), F.lit("Motivo:"), reason_lines("match_reason"),
        F.lit(""), F.lit("Link para aplicar:"), text("url"),
    )


def packed(entries: Column, header: Column, footer: Column, limit: int, floor: int = DEFAULTS.digest_min_chars) -> Column:
    """Array of arrays of entries: in order, a new part when header, entries and footer would exceed the limit; an oversize entry stands alone."""
    most = max(floor, limit)
    around = F.when(header != "", F.length(header) + len(SEPARATOR)).otherwise(0) + F.when(footer != "", F.length(footer) + len(SEPARATOR)).otherwise(0)
    none = F.expr("cast(array() as array<string>)")
    start = F.struct(F.expr("cast(array() as array<array<string>>)").alias("parts"), none.alias("now"), F.lit(0).alias("size"))

    def step(s: Column, e: Column) -> Column:
        grown = s["size"] + F.when(F.size(s["now"]) > 0, len(SEPARATOR)).otherwise(0) + F.length(e)
        full = (F.size(s["now"]) > 0) & (grown + around > most)
        return F.when(full, F.struct(F.concat(s["parts"], F.array(s["now"])).alias("parts"), F.array(e).alias("now"), F.length(e).alias("size"))).otherwise(
            F.struct(s["parts"].alias("parts"), F.concat(s["now"], F.array(e)).alias("now"), grown.alias("size"))
        )

    return F.aggregate(entries, start, step, lambda s: F.when(F.size(s["now"]) > 0, F.concat(s["parts"], F.array(s["now"]))).otherwise(s["parts"]))


def heading(offers: Column, settings: Settings = DEFAULTS) -> Column:
    """What stands above the entries of each part."""
    return F.concat_ws("\n", F.lit(settings.digest_title), F.lit(""), F.concat(F.lit("Encontradas en este ciclo: "), offers.cast("string")), F.lit(f"Umbral mínimo: {int(settings.match_threshold)}%"))


def numbered_part(body: Column, part: Column | str, parts: Column | str) -> Column:
    """A message that says which of several parts it is."""
    one, all_of = (F.col(c) if isinstance(c, str) else c for c in (part, parts))
    return F.when(all_of > 1, F.concat(body, F.lit(SEPARATOR), F.format_string("Parte %d/%d", one, all_of))).otherwise(body)


def _unbounded(offers: DataFrame, settings: Settings, by: str | None, last: str) -> DataFrame:
    """Messages of lists of any length: positions by ranges of the order, parts by a scan over chunks, then a row a part."""
    group = [by] if by else []
    ranked = positions(offers, rank_order(last=last), by)
    told = ranked.select(*group, "base", "position", F.col(last).alias("key"), heading(F.col("members"), settings).alias("header"), entry_text(settings).alias("entry"))
    # texts are made once; the scan reads their lengths
    told = written(told)
    room = F.lit(max(settings.digest_min_chars, settings.digest_max_chars)) - F.length("header") - len(SEPARATOR)
    cut = part_numbers(told.select("base", "position", F.length("entry").cast("long").alias("chars"), room.cast("long").alias("room")))
    items = F.array_sort(F.collect_list(F.struct("position", "key", "entry")))
    messages = told.join(cut, ["base", "position"]).groupBy(*group, "base", "part").agg(items.alias("items"), F.first("header").alias("header"))
    whole = cut.groupBy("base").agg(F.max("part").alias("parts"))
    body = F.concat_ws(SEPARATOR, F.col("header"), F.array_join(F.transform("items", lambda i: i["entry"]), SEPARATOR))
    out = messages.join(whole, "base").select(*group, F.col("part").cast("int").alias("part"), F.col("parts").cast("int").alias("parts"), body.alias("body"), F.transform("items", lambda i: i["key"]).alias("keys"))
    return out.select(*group, "part", "parts", numbered_part(F.col("body"), "part", "parts").alias("message"), "keys")


def digest(offers: DataFrame, settings: Settings = DEFAULTS, by: str | None = None, last: str = "url_hash") -> DataFrame:
    """(by, part, parts, message, keys): messages of the ranked offers, of each group if by names one.

    A list that digest_max_rows bounds is packed where its rows meet; without a bound it is packed in chunks, at once (see long_digest).
    """
    if settings.digest_max_rows <= 0:
        return _unbounded(offers, settings, by, last)
    group = by or "__one"
    rows = offers if by else offers.withColumn("__one", F.lit(1))
    ranked = top_rows(rows, settings.digest_max_rows, rank_order(last=last), by=group if by else None)
    told = ranked.select(group, "position", "overflow", F.col(last).alias("key"), entry_text(settings).alias("entry"))
    lists = told.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("position", "key", "entry"))).alias("items"), F.max("overflow").alias("overflow"))
    header = heading(F.size("items"), settings)
    footer = F.when(F.col("overflow") > 0, F.concat(F.lit("Hay "), F.col("overflow").cast("string"), F.lit(" ofertas adicionales guardadas."))).otherwise("")
    lists = lists.withColumns({"header": header, "footer": footer})
    lists = lists.withColumn("packed", packed(F.transform("items", lambda i: i["entry"]), F.col("header"), F.col("footer"), settings.digest_max_chars, settings.digest_min_chars))
    ends = F.aggregate(F.transform("packed", lambda p: F.size(p)), F.expr("cast(array() as array<int>)"), lambda a, n: F.concat(a, F.array(n + F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0)))))
    parts = lists.withColumn("__ends", ends).select(group, "items", "header", "footer", "__ends", F.size("packed").alias("parts"), F.posexplode("packed").alias("at", "entries"))
    begin = F.when(F.col("at") == 0, 0).otherwise(F.try_element_at("__ends", F.col("at")))
    body = F.concat_ws(SEPARATOR, F.col("header"), F.array_join("entries", SEPARATOR), F.when((F.col("at") == F.col("parts") - 1) & (F.col("footer") != ""), F.col("footer")))
    out = parts.select(group, (F.col("at") + 1).alias("part"), "parts", numbered_part(body, F.col("at") + 1, "parts").alias("message"), F.transform(F.slice("items", begin + 1, F.size("entries")), lambda i: i["key"]).alias("keys"))
    return out if by else out.drop("__one")


def queue_first(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """One queued row per offer: the first that arrived."""
    w = Window.partitionBy(key).orderBy(arrival)
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def outbox(attempted: DataFrame, delivered: DataFrame, key: str) -> DataFrame:
    """attempted rows with status: sent, pending if others were delivered, error if none was."""
    some = delivered.limit(1).agg((F.count(F.lit(1)) > 0).alias("__some"))
    marks = delivered.select(key).distinct().withColumn("__sent", F.lit(True))
    rows = attempted.join(marks, key, "left").crossJoin(F.broadcast(some))
    return rows.withColumn("status", F.when(F.col("__sent"), "sent").when(F.col("__some"), "pending").otherwise("error")).drop("__sent", "__some")


def delivery_class(delivered: Column, total: Column) -> Column:
    return F.when((total > 0) & (delivered == total), "all").when(delivered > 0, "some").otherwise("none")


def fan_out(messages: DataFrame, recipients: list[str]) -> DataFrame:
    """A row per message and recipient."""
    return messages.withColumn("recipient", F.explode(F.array(*(F.lit(r) for r in recipients)).cast("array<string>")))


def marked(offers: DataFrame, delivered: DataFrame, key: str, at: Column) -> DataFrame:
    """Offers whose delivery is known to have worked are marked with its time, others are not."""
    marks = delivered.select(key).distinct().withColumn("__sent", F.lit(True))
    rows = offers.join(marks, key, "left")
    return rows.withColumn("notified_at", F.when(F.col("__sent"), at).otherwise(F.col("notified_at"))).withColumn("notified", F.coalesce("__sent", F.col("notified"), F.lit(False))).drop("__sent")
