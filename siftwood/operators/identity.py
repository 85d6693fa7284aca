"""Which listings are one offer: connected components over canonical URLs and names, however long the chains are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import text
from ..functions.urls import canonical_url
from ..shared import written


def tokens() -> Column:
    """What a listing is known by, as digests: its canonical URL, and its title, company and portal in lower case; blank ones and names without a title or company are none."""
    url, name = F.trim(canonical_url("url")), [F.lower(text(c)) for c in ("title", "company", "portal")]
    named = (F.trim(name[0]) != "") & (F.trim(name[1]) != "")
    by_url = F.when(F.trim(text("url")) != "", F.md5(F.concat(F.lit("u"), url).cast("binary")))
    by_name = F.when(named, F.md5(F.concat(F.lit("n"), F.concat_ws("\x1f", *name)).cast("binary")))
    return F.array_compact(F.array(by_url, by_name))


def components(members: DataFrame, node: str = "seq", token: str = "token") -> DataFrame:
    """(node, component): the smallest node that can be reached by shared tokens; only nodes that have a token, once each.

    members: a row for each token of each node. A token's nodes are linked as a star to its smallest, so a token of many nodes gives one link a node, and the smallest is found by an
    aggregate that combines before its shuffle. In a round every node takes its smallest neighbour, chains of such steps are followed by
    doubling, and links are drawn between what remains: rounds and doublings grow with the logarithm of a chain's length. Nulls of either column are left out.
    """
    rows = members.select(F.col(node).alias("v"), F.col(token).alias("t")).where("v is not null and t is not null")
    hubs = rows.groupBy("t").agg(F.min("v").alias("hub"))
    stars = rows.join(hubs, "t")
    # every node of a round is in its links; the hub of all its tokens is linked to itself alone
    links = written(stars.select(F.col("v").alias("a"), F.col("hub").alias("b")).distinct())
    nodes = links.select(F.col("a").alias("v")).distinct()
    steps = []
    links = links.where("a <> b")
    while not links.isEmpty():
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("p")).withColumn("p", F.least("v", "p")))
        while True:
            up = parents.select(F.col("v").alias("p"), F.col("p").alias("q"))
            jumped = written(parents.join(up, "p").select("v", F.col("q").alias("p"), (F.col("q") != F.col("p")).alias("moved")))
            parents = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        steps.append(parents)
        a, b = (parents.select(F.col("v").alias(c), F.col("p").alias(f"p{c}")) for c in "ab")
        links = written(links.join(a, "a").join(b, "b").select(F.col("pa").alias("a"), F.col("pb").alias("b")).where("a <> b").distinct())
    found = nodes.withColumn("component", F.col("v"))
    for parents in steps:
        found = found.join(parents.withColumnRenamed("v", "component"), "component", "left").select("v", F.coalesce("p", "component").alias("component"))
    return found.withColumnRenamed("v", node)


def known_by(rows: DataFrame, seq: str = "seq") -> DataFrame:
    """(seq, token) of listings."""
    return rows.select(seq, F.explode(tokens()).alias("token"))


def with_component(rows: DataFrame, found: DataFrame | None = None, seq: str = "seq") -> DataFrame:
    """rows with component: the smallest seq of the listings that are the same offer; a listing known by nothing is alone. Rows of one seq are one listing. found: components that are known."""
    if found is None:
        found = components(known_by(rows, seq), seq)
    return rows.join(found, seq, "left").withColumn("component", F.coalesce("component", F.col(seq)))
