"""Ids to labels and labels to ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quercus.functions.text import extract_ids, placeholders, replace_ids, strip

KINDS = {"Q": "entity", "P": "property", "L": "lexeme"}


def lookup(rows: DataFrame, key: Column, dictionary: DataFrame, dict_key: str) -> DataFrame:
    """Left join with a dictionary that is unique per key.

    Its size, known when the plan runs, decides between a broadcast and a shuffle; an id that makes up
    a third of all rows is split by the adaptive skew join, as only the row side can be skewed.
    """
    right = dictionary.withColumnRenamed(dict_key, "_dict_key")
    return rows.withColumn("_key", key).join(right, F.col("_key") == F.col("_dict_key"), "left").drop("_key", "_dict_key")


def best_labels(dictionary: DataFrame) -> DataFrame:
    """One label per id: English if there is one, else the first language (by ``pos`` where the
    dictionary has it, else by name); trimmed."""
    first = F.col("pos") if "pos" in dictionary.columns else F.col("lang")
    order = F.struct(F.col("lang") != "en", first, F.col("label"))
    return dictionary.groupBy("id").agg(strip(F.min_by("label", order)).alias("label"))


def label_lookup(ids: DataFrame, dictionary: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(id) -> (id, label). A redirected id takes its target's label; an unknown id is its own."""
    wanted = ids.select("id").distinct()
    if redirects is not None:
        wanted = wanted.join(redirects.select(F.col("id"), F.col("target")), "id", "left")
    else:
        wanted = wanted.withColumn("target", F.lit(None).cast("string"))
    labels = best_labels(dictionary).withColumnRenamed("id", "_id")
    resolved = F.coalesce("target", "id")
    return wanted.join(labels, resolved == F.col("_id"), "left").select(
        "id", F.coalesce("label", resolved).alias("label")
    )


def label_query(df: DataFrame, dictionary: DataFrame, query: str = "query", key: str = "row_id", out: str = "query_templated") -> DataFrame:
    """``:Q1`` -> ``:[entity:label]`` and so on, whole ids only.

    Only (row key, id) pairs travel to the dictionary; each row gets back a small map of the ids in
    its own text.
    """
    ids = df.select(key, F.explode(F.array_distinct(extract_ids(F.col(query)))).alias("_id"))
    found = lookup(ids, F.col("_id"), best_labels(dictionary), "id")
    kind = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])[F.substring("_id", 1, 1)]
    text = F.concat(F.lit(":["), kind, F.lit(":"), F.coalesce("label", "_id"), F.lit("]"))
    maps = (
        found.select(key, F.struct(F.concat(F.lit(":"), "_id").alias("k"), text.alias("v")).alias("entry"))
        .groupBy(key).agg(F.map_from_entries(F.collect_list("entry")).alias("_map"))
    )
    joined = df.join(maps, key, "left")
    rewritten = replace_ids(F.col(query), lambda p: F.try_element_at(F.col("_map"), p))
    return joined.withColumn(out, F.when(F.col("_map").isNull(), F.col(query)).otherwise(rewritten)).drop("_map")


def normal_label(label: Column) -> Column:
    return F.lower(strip(label))


def first_hits(dictionary: DataFrame) -> DataFrame:
    """Per (kind, normalised label) the first hit: the lowest id number; ids without one come last."""
    number = F.coalesce(F.regexp_extract("id", r"(\d+)", 1).try_cast("bigint"), F.lit((1 << 63) - 1))
    shown = F.coalesce("label", "description") if "description" in dictionary.columns else F.col("label")
    return (
        dictionary.select("kind", normal_label(shown).alias("norm"), "id", shown.alias("matched"), number.alias("n"))
        .groupBy("kind", "norm")
        .agg(F.min_by(F.struct("id", "matched"), F.struct("n", "id", "matched")).alias("hit"))
    )


def link_take_first(labels: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(label, kind) -> id and matched text: first hit of the kind, else of the other kind, else
    the label itself. Both tries are one join: hits are kept per label as (entity hit, property hit)."""
    hits = first_hits(dictionary).groupBy("norm").agg(
        F.max(F.when(F.col("kind") == "entity", F.col("hit"))).alias("entity_hit"),
        F.max(F.when(F.col("kind") == "property", F.col("hit"))).alias("property_hit"),
    )
    joined = lookup(labels, normal_label(F.col("label")), hits, "norm")
    own = F.struct(F.col("label").alias("id"), F.col("label").alias("matched"))
    chosen = F.when(F.col("kind") == "property", F.coalesce("property_hit", "entity_hit", own)).otherwise(
        F.coalesce("entity_hit", "property_hit", own)
    )
    return joined.withColumn("_hit", chosen).select(*labels.columns, "_hit.id", "_hit.matched")


def search_hits(labels: DataFrame, dictionary: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """(label, kind) -> id, matched text and rank of the best hit of a search over labels.

    A label is hit if the text asked for stands in it from the start of a word; its last word may go
    on. Rank 0 is the whole label, 1 its beginning, 2 a later place; then the lowest id number. Without a
    hit of its kind a text takes the other kind's, else itself with no rank, like an empty or null text.
    A hit that is redirected (``redirects``: id, target) gives its target and the target's best label.

    Each label is indexed under what it begins with from each of its words on, at the lengths that are
    asked for; only asked keys are kept, and each task leaves one hit per key, so that a word that is in
    a third of all labels does not meet in one place.
    """
    wanted = labels.select(normal_label(F.col("label")).alias("norm")).filter(F.col("norm") != "").distinct()
    lengths = wanted.select(F.array_sort(F.collect_set(F.length("norm"))).alias("n")).scalar()  # of labels, so a few hundred at most
    shown = F.coalesce("label", "description") if "description" in dictionary.columns else F.col("label")
    number = F.coalesce(F.regexp_extract("id", r"(\d+)", 1).try_cast("bigint"), F.lit((1 << 63) - 1))
    given = dictionary.select("kind", "id", shown.alias("matched"), number.alias("n"), normal_label(shown).alias("text"))
    given = given.filter(F.col("text") != "").withColumn("lengths", lengths)
    words = F.filter(
        F.sequence(F.lit(1), F.length("text")),
        lambda i: (i == 1) | ((F.substring("text", i - 1, F.lit(1)) == " ") & (F.substring("text", i, F.lit(1)) != " ")),
    )
    starts = given.select("*", F.explode(words).alias("start")).withColumn("rest", F.col("text").substr(F.col("start"), F.length("text")))
    fits = F.filter("lengths", lambda k: k <= F.length("rest"))
    keys = starts.select("kind", "id", "matched", "n", "text", "start", "rest", F.explode(fits).alias("k"))
    keys = keys.withColumn("norm", F.col("rest").substr(F.lit(1), F.col("k")))
    rank = F.when(F.col("norm") == F.col("text"), 0).when(F.col("start") == 1, 1).otherwise(2)
    hit = F.struct(rank.alias("rank"), "n", "id", "matched")
    best = keys.join(wanted, "norm", "left_semi").groupBy("norm", "kind").agg(F.min(hit).alias("hit"))
    best = best.groupBy("norm").agg(
        F.max(F.when(F.col("kind") == "entity", F.col("hit"))).alias("entity_hit"),
        F.max(F.when(F.col("kind") == "property", F.col("hit"))).alias("property_hit"),
    )
    joined = lookup(labels, normal_label(F.col("label")), best, "norm")
    own = F.when(F.col("kind") == "property", F.coalesce("property_hit", "entity_hit")).otherwise(F.coalesce("entity_hit", "property_hit"))
    found = joined.withColumn("_hit", own).drop("entity_hit", "property_hit")
    if redirects is None:
        target, label = F.lit(None).cast("string"), F.lit(None).cast("string")
    else:
        moved = redirects.groupBy("id").agg(F.min("target").alias("_target"))
        moved = moved.join(best_labels(dictionary).select(F.col("id").alias("_target"), F.col("label").alias("_label")), "_target", "left")
        found = lookup(found, F.col("_hit.id"), moved, "id")
        target, label = F.col("_target"), F.coalesce("_label", "_target")
    return found.select(
        *[F.col(f"`{c}`") for c in labels.columns], F.coalesce(target, F.col("_hit.id"), F.col("label")).alias("id"),
        F.coalesce(label, F.col("_hit.matched"), F.col("label")).alias("matched"), F.col("_hit.rank").alias("rank"),
    )


def with_placeholders(df: DataFrame, text: str, entities: str = "extracted_entities", properties: str = "extracted_properties") -> DataFrame:
    return df.withColumn(entities, placeholders(F.col(text), "entity")).withColumn(
        properties, placeholders(F.col(text), "property")
    )


def link_placeholders(
    df: DataFrame, dictionary: DataFrame, key: str = "row_id",
    entities: str = "extracted_entities", properties: str = "extracted_properties",
) -> DataFrame:
    """Adds ``linked_entities`` and ``linked_properties``: array<struct<label, id, matched>>, in the
    order of the extracted labels."""

    def listed(kind, column):
        return F.transform(
            F.coalesce(F.col(column), F.array().cast("array<string>")),
            lambda label, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), label.alias("label")),
        )

    wanted = df.select(key, F.inline(F.concat(listed("entity", entities), listed("property", properties))))
    linked = link_take_first(wanted, dictionary)
    item = F.struct("pos", "label", "id", "matched")

    def collected(kind):  # bounded by the labels of one text
        ordered = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, item)))
        return F.transform(ordered, lambda x: F.struct(x["label"].alias("label"), x["id"].alias("id"), x["matched"].alias("matched")))

    per_row = linked.groupBy(key).agg(
        collected("entity").alias("linked_entities"), collected("property").alias("linked_properties")
    )
    empty = F.array().cast("array<struct<label:string,id:string,matched:string>>")
    joined = df.join(per_row, key, "left")
    return joined.withColumn("linked_entities", F.coalesce("linked_entities", empty)).withColumn(
        "linked_properties", F.coalesce("linked_properties", empty)
    )
