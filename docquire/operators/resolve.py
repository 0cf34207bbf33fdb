"""Entity resolution: documents that values connect, directly or through others, become one merged record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docquire.operators.fields import link
from docquire.operators.scratch import cut, drop

#: How the value of a field is chosen among an entity's values: smaller comes first, the value itself settles ties.
PRECEDENCE = {
    "common": lambda: [-F.col("n_docs"), F.col("first")],  # in most documents, then in the earliest
    "first": lambda: [F.col("first")],  # in the earliest document, there at the earliest place
    "last": lambda: [-F.col("last.doc"), -F.col("last.ordinal")],  # in the latest document, there at the last place
    "longest": lambda: [-F.length("value")],
}


def components(links: DataFrame) -> DataFrame:
    """node, component: the smallest node that the links a, b reach, for each node with a link.

    Rounds of two steps until nothing changes: each node's larger neighbours are tied to its smallest one, then each node
    and all its smaller neighbours to the smallest. A chain of n links shrinks by a constant factor a round. Every step is
    a minimum that combines before the shuffle and a sort-merge join that splits a hub's rows, and is written out.
    """
    edges = cut(links.select("a", "b").where("a <> b").distinct(), "links")
    seen = None
    while True:
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("near")).union(edges.select(F.col("b").alias("node"), F.col("a").alias("near")))
        least = cut(both.groupBy("node").agg(F.min("near").alias("m")).select("node", F.least("node", "m").alias("m")), "least")
        up = both.where("near > node").join(least.hint("merge"), "node").select(F.col("near").alias("a"), F.col("m").alias("b"))
        tied = cut(up.where("a <> b").distinct(), "tied")
        drop(edges, least)
        down = tied.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("near"))
        least = cut(down.groupBy("node").agg(F.min("near").alias("m")), "least")
        across = down.join(least.hint("merge"), "node").select(F.col("near").alias("a"), F.col("m").alias("b"))
        edges = cut(across.union(least.select(F.col("node").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct(), "links")
        drop(tied, least)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if state == seen:
            break
        seen = state
    # now every edge is a star from a component's smallest node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(edges.select(F.col("b"), F.col("b")).distinct())


def entities(fields: DataFrame, link_on: list[str], key: str = "doc_id") -> DataFrame:
    """The fields with entity: the smallest key that shares values of the `link_on` fields, also through others."""
    stars = link(fields.where(F.col("field").isin(link_on)), key).select(F.col(key).alias("a"), F.col("first_doc").alias("b"))
    of = cut(components(stars).withColumnRenamed("node", key), "entities")
    return fields.join(of.hint("merge"), key, "left").withColumn("entity", F.coalesce("component", key)).drop("component")


def merge_records(members: DataFrame, precedence: dict[str, str], key: str = "doc_id") -> DataFrame:
    """entity, n_docs, n_values, n_conflicts (fields with several values), and each field's value by its precedence.

    Values count once a document before anything else, so an entity or value of very many documents stays a partial sum a
    task. Fields without a precedence are left out of the record and its counts.
    """
    known = members.where(F.col("field").isin(list(precedence)))
    place = F.struct(F.col(key).alias("doc"), "ordinal")
    values = known.groupBy("entity", "field", "value").agg(F.countDistinct(key).alias("n_docs"), F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n"))
    chosen, several = [], F.lit(0).cast("long")
    for name, rule in precedence.items():
        mine = F.col("field") == name
        order: list[Column] = [x.alias(f"o{i}") for i, x in enumerate(PRECEDENCE[rule]())]
        chosen.append(F.min(F.when(mine, F.struct(*order, F.col("value")))).getField("value").alias(name))
        several += (F.count(F.when(mine, 1)) > 1).cast("long")
    merged = values.groupBy("entity").agg(F.sum("n").alias("n_values"), several.alias("n_conflicts"), *chosen)
    sizes = known.groupBy("entity").agg(F.countDistinct(key).alias("n_docs"))
    return merged.join(sizes.hint("merge"), "entity").select("entity", "n_docs", "n_values", "n_conflicts", *precedence)


def resolve(fields: DataFrame, link_on: list[str], precedence: dict[str, str], key: str = "doc_id") -> DataFrame:
    """One merged record for each entity. Null keys and values link nothing; a document of its own is an entity.

    The fields are written out first: links, entities and records all read them, and texts are searched once.
    """
    known = cut(fields.where(F.col(key).isNotNull() & F.col("value").isNotNull()).select(key, "field", "ordinal", "value"), "fields")
    return merge_records(cut(entities(known, link_on, key), "members"), precedence, key)
