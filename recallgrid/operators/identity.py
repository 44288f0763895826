"""Typed identity records in one wide table: item_type, content, secondary, tertiary, category.

Where a table holds the identities of many owners, ``by`` names the columns that tell these apart, and each owner's items
are a group of their own; without it all items are of one identity."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPES = ("persona_name", "persona_description", "value", "preference", "relationship", "rule")
SCHEMA = "id string, item_type string, content string, secondary string, tertiary string, category string, created_at long"


def search(items: DataFrame, term: str) -> DataFrame:
    """Items other than the persona that hold a term in any field."""
    t = term.lower()
    hit = F.lit(False)
    for c in ("content", "secondary", "tertiary", "category"):
        hit = hit | F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))
    return items.where(hit & ~F.col("item_type").startswith("persona"))


def categories(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return items.where("item_type in ('value', 'preference') and category is not null").select(*by, "category").distinct()


def by_type(items: DataFrame, item_type: str) -> DataFrame:
    return items.where(F.col("item_type") == item_type).orderBy("created_at", "id")


def relationship(items: DataFrame, entity: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The first relationship with an entity, whatever the case; of each owner its own."""
    hits = items.where((F.col("item_type") == "relationship") & (F.lower("content") == entity.lower()))
    first = F.min_by(F.struct(*items.columns), F.struct("created_at", "id")).alias("first")
    return hits.groupBy(*by).agg(first).where("first is not null").select("first.*")


def add(items: DataFrame, item_type: str, content: str, created_at: int, secondary=None, tertiary=None, category=None) -> DataFrame:
    """Append an item; persona items replace the one there is; a negative rule is told by its category."""
    if item_type not in TYPES:
        raise ValueError(f"unknown item type {item_type!r}")
    row = items.sparkSession.createDataFrame([(uuid.uuid4().hex[:8], item_type, content, secondary, tertiary, category, created_at)], SCHEMA)
    rest = items.where(F.col("item_type") != item_type) if item_type.startswith("persona") else items
    return rest.unionByName(row)


def put(items: DataFrame, fresh: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Append items of many owners at once. Persona items replace those of their owner and type; of several new ones the last counts."""
    is_persona = F.col("item_type").startswith("persona")
    last = F.max_by(F.struct(*items.columns), F.struct("created_at", "id")).alias("last")
    persona = fresh.where(is_persona).groupBy(*by, "item_type").agg(last).select("last.*")
    rest = items.join(persona.select(*by, "item_type"), [*by, "item_type"], "left_anti")
    return rest.select(*items.columns).unionByName(persona).unionByName(fresh.where(~is_persona))


def remove(items: DataFrame, item_id: str) -> DataFrame:
    return items.where(F.col("id") != item_id)


def retyped(items: DataFrame, old: str, new: str, category: str | None = None) -> DataFrame:
    """Items of one type under another, with a category if given."""
    hit = F.col("item_type") == old
    given: Column = F.lit(category) if category is not None else F.col("category")
    return items.withColumn("category", F.when(hit, given).otherwise(F.col("category"))).withColumn("item_type", F.when(hit, new).otherwise(F.col("item_type")))


# Types of an older layout, and how what they hold is named in the description.
ABSORBED = (("trait", "Traits"), ("tone", "Tone"), ("expertise", "Expertise"))


def set_persona(items: DataFrame, field: str, content: str, created_at: int) -> DataFrame:
    """The persona's name or description set, in place of any there was."""
    return add(items, f"persona_{field}", content, created_at)


def add_rule(items: DataFrame, content: str, created_at: int, instead=None, why=None, negative: bool = False) -> DataFrame:
    return add(items, "rule", content, created_at, instead, why, "negative" if negative else None)


def absorbed(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Items of the older layout in the present one: traits, tones and expertise go into the persona's description, one sentence
    each with their contents in order; directives become rules and antipatterns negative rules. Items without such types
    stay as they are. The lists are of one owner's items, a few dozen."""
    listed = lambda kind: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("item_type") == kind, F.struct("created_at", "id", "content")))), lambda x: x["content"]), ", ")
    first = F.min(F.when(F.col("item_type") == "persona_description", F.struct("created_at", "id", "content")))
    told = items.groupBy(*by).agg(first["content"].alias("old"), F.coalesce(first["created_at"], F.lit(0)).alias("created_at"), *(listed(kind).alias(kind) for kind, _ in ABSORBED))
    text = F.coalesce(F.col("old"), F.lit(""))
    for kind, name in ABSORBED:
        sentence = F.concat(F.regexp_replace(text, r"\.+$", ""), F.lit(f" {name}: "), F.col(kind), F.lit("."))
        if kind == "trait":  # without a description, the traits are it
            sentence = F.when(text == "", F.concat(F.lit(f"{name}: "), F.col(kind))).otherwise(sentence)
        text = F.when(F.col(kind) == "", text).otherwise(sentence)
    none = F.lit(None).cast("string")
    told = told.select(*by, text.alias("content"), "old", "created_at").where("content != coalesce(old, '')")
    fresh = told.select(*by, F.substring(F.md5(F.concat_ws("|", *by, "content")), 1, 8).alias("id"), F.lit("persona_description").alias("item_type"), "content", none.alias("secondary"), none.alias("tertiary"), none.alias("category"), F.col("created_at").cast("long").alias("created_at"))
    kept = items.where(~F.col("item_type").isin(*(kind for kind, _ in ABSORBED)))
    description = F.col("item_type") == "persona_description"
    gone = told.select(*by, F.lit("persona_description").alias("item_type"))
    kept = kept.where(~description).unionByName(kept.where(description).join(gone, [*by, "item_type"], "left_anti").select(*kept.columns))
    return retyped(retyped(kept, "directive", "rule"), "antipattern", "rule", "negative").unionByName(fresh)


def listed(items: DataFrame, raw_type: str) -> DataFrame:
    """Items by the very string of their type, known or not."""
    return items.where(F.col("item_type") == raw_type).orderBy("created_at", "id")


def removed_type(items: DataFrame, raw_type: str) -> DataFrame:
    return items.where(F.col("item_type") != raw_type)


def assembled(items: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """An identity as one row: name, description, and values, preferences, relationships and rules as arrays in order of
    creation. Items of unknown type play no part; of several names or descriptions the last counts."""
    placed = lambda kind, *fields: F.transform(F.sort_array(F.collect_list(F.when(F.col("item_type") == kind, F.struct("created_at", "id", F.struct(*fields).alias("item"))))), lambda x: x["item"])
    last = lambda kind: F.max(F.when(F.col("item_type") == kind, F.struct("created_at", "id", "content")))["content"]
    content, second, third, category = F.col("content"), F.col("secondary"), F.col("tertiary"), F.col("category")
    return items.groupBy(*by).agg(
        F.coalesce(last("persona_name"), F.lit("")).alias("name"),
        F.coalesce(last("persona_description"), F.lit("")).alias("description"),
        placed("value", content.alias("principle"), second.alias("why"), category.alias("category")).alias("values"),
        placed("preference", content.alias("prefer"), second.alias("over"), category.alias("category")).alias("preferences"),
        placed("relationship", content.alias("entity"), F.coalesce(second, F.lit("")).alias("relation"), category.alias("context")).alias("relationships"),
        placed("rule", content.alias("content"), second.alias("instead"), third.alias("why"), F.coalesce(category == "negative", F.lit(False)).alias("negative")).alias("rules"),
    )


def from_blob(items: DataFrame, blob: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Items of assembled identities (rows as assembled gives them), for owners that have none yet."""
    none = F.lit(None).cast("string")

    def rows(kind: str, array: str, content: str, second: Column, third: Column, category: Column, order: int) -> DataFrame:
        each = blob.select(*by, F.posexplode(array).alias("pos", "x"))
        return each.select(*by, F.lit(kind).alias("item_type"), F.col(f"x.{content}").alias("content"), second.alias("secondary"), third.alias("tertiary"), category.alias("category"), F.lit(order).alias("list"), "pos")

    x = lambda name: F.col(f"x.{name}")
    persona = blob.select(*by, F.explode(F.array(F.struct(F.lit("persona_name").alias("item_type"), F.col("name").alias("content"), F.lit(0).alias("pos")), F.struct(F.lit("persona_description").alias("item_type"), F.col("description").alias("content"), F.lit(1).alias("pos")))).alias("p"))
    every = persona.select(*by, "p.item_type", "p.content", none.alias("secondary"), none.alias("tertiary"), none.alias("category"), F.lit(0).alias("list"), "p.pos").where("content != ''")
    for part in (
        rows("value", "values", "principle", x("why"), none, x("category"), 1),
        rows("preference", "preferences", "prefer", x("over"), none, x("category"), 2),
        rows("relationship", "relationships", "entity", x("relation"), none, x("context"), 3),
        rows("rule", "rules", "content", x("instead"), x("why"), F.when(x("negative"), "negative"), 4),
    ):
        every = every.unionByName(part)
    place = (F.col("list") * 1_000_000 + F.col("pos")).cast("long")
    fresh = every.select(*by, F.substring(F.md5(F.concat_ws("|", *by, "item_type", place.cast("string"))), 1, 8).alias("id"), "item_type", "content", "secondary", "tertiary", "category", place.alias("created_at"))
    if by:
        return items.unionByName(fresh.join(items.select(*by).distinct(), [*by], "left_anti").select(*items.columns))
    empty = F.broadcast(items.agg((F.count("*") == 0).alias("empty")))
    return items.unionByName(fresh.crossJoin(empty).where("empty").drop("empty"))


# Marks of items, of rules to follow and not to, and of what stands instead.
BULLET, CROSS, DASH, ARROW = "  • ", "  ✗ ", " — ", " → "


def render(items: DataFrame) -> str:
    """The identity as tagged text: persona, values, preferences, relationships, and rules as dos and don'ts. One row comes to
    the driver, of one identity's items, all of them."""
    me = assembled(items).first()
    persona = f"I am {me.name}. {me.description}" if me.name and me.description else f"I am {me.name}." if me.name else me.description
    why = lambda text: f"\n    ({text})" if text else ""
    does = [f"{BULLET}{r.content}{DASH + r.instead if r.instead else ''}{why(r.why)}" for r in me.rules if not r.negative]
    donts = [f"{CROSS}{r.content}{ARROW + r.instead if r.instead else ''}{why(r.why)}" for r in me.rules if r.negative]
    parts = {
        "persona": [persona] if persona else [],
        "values": [f"{BULLET}{v.principle}{why(v.why)}" for v in me["values"]],
        "preferences": [f"{BULLET}{p.prefer}{f' > {p.over}' if p.over else ''}" for p in me.preferences],
        "relationships": [f"{BULLET}{r.entity}: {r.relation}{why(r.context)}" for r in me.relationships],
        "rules": [*(["Do:", *does] if does else []), *([""] if does and donts else []), *(["Don't:", *donts] if donts else [])],
    }
    return "".join(f"<{name}>\n" + "\n".join(lines) + f"\n</{name}>\n\n" for name, lines in parts.items() if lines)
