"""Entity resolution: ids, names, fuzzy clusters, merges and their validation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.functions.parsing import investor_name, normalized_name
from granary.operators.containment import by_name
from granary.operators.graph import checkpoints, components


def resolve(rows: DataFrame, order: str, source: str, source_id: str, name: str, country: str) -> DataFrame:
    """Adds entity_id (the order of the row that created it) and how: rows of a known (source, id) follow the first of
    them; of these leaders the first of each normalised name and country (in any case) creates an entity, the others match it.
    A null source or id, an empty or null name and a null country match nothing. Firsts are groupings, joined to the rows
    again, so no id's or name's rows meet in one window."""
    named = rows.withColumns({"_name": F.nullif(normalized_name(F.col(name)), F.lit("")), "_place": F.lower(country)})
    by_id = rows.where(F.col(source).isNotNull() & F.col(source_id).isNotNull()).groupBy(source, source_id).agg(F.min(order).alias("_lead"))
    led = named.join(by_id, [source, source_id], "left").withColumn("_lead", F.coalesce("_lead", order))
    leaders = led.where(F.col(order) == F.col("_lead")).select("_lead", "_name", "_place")
    known = leaders.where("_name is not null and _place is not null").groupBy("_name", "_place").agg(F.min("_lead").alias("_first"))
    own = leaders.join(known, ["_name", "_place"], "left").select("_lead", F.coalesce("_first", "_lead").alias("entity_id"))
    how = F.when(F.col(order) != F.col("_lead"), "source_id").when(F.col("entity_id") != F.col(order), "name_country").otherwise("created")
    return led.join(own, "_lead").withColumn("how", how).select(*rows.columns, "entity_id", "how")


def investor_references(leads: DataFrame, references: DataFrame, lead_id: str, lead: str, legal: str) -> DataFrame:
    """leads with ref_id, tier, assets, how and quality of their reference (ref_id, tier, assets): that of the same investor's name, the least
    id first, else of those that contain it the best tier, then the largest assets."""
    near = [F.col("tier"), F.coalesce(-F.col("assets"), F.lit(float("inf"))).alias("less"), F.col("ref_id")]
    found = by_name(leads, references, lead_id, investor_name(F.col(lead)), investor_name(F.col(legal)), ["ref_id", "tier", "assets"], [F.col("ref_id")], near)
    #: The quality of each tier.
    return found.withColumn("quality", F.when(F.col("tier") == "A", 1.0).when(F.col("tier") == "B", 0.75).when(F.col("tier").isNotNull(), 0.45))


#: Names of a tile of a block: a block of more is compared tile by tile.
TILE = 1000


def fuzzy_clusters(rows: DataFrame, key: str, name: str, block: list[str], least: float = 0.85) -> DataFrame:
    """(id, root) of rows whose names are similar: candidates share the block's columns and the first four letters of
    the normalised name, similarity is 1 - edit distance / length, clusters are connected components. Equal names are
    compared once; a large block is many pairs of tiles, so none is one task."""
    blocks = [f"_b{i}" for i in range(len(block))]  # names of their own, as those of rows may be any
    n = rows.select(F.col(key).alias("_key"), normalized_name(F.col(name)).alias("_n"), *[F.col(b).alias(x) for b, x in zip(block, blocks, strict=True)])
    n = n.where("_n <> ''").withColumn("_p", F.substring("_n", 1, 4))
    by = ["_p", *blocks]
    names = n.groupBy("_n", *by).agg(F.min("_key").alias("_a"))
    same = n.join(names, ["_n", *by]).select("_a", F.col("_key").alias("_c")).where("_a <> _c")
    tiles = names.groupBy(*by).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_tiles"))
    placed = names.join(tiles, by).withColumn("_t", F.pmod(F.xxhash64("_a"), F.col("_tiles")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1))
    left = placed.select("_a", F.col("_n").alias("_na"), *by, F.col("_t").alias("_i"), every.alias("_j"))
    right = placed.select(F.col("_a").alias("_c"), F.col("_n").alias("_nc"), *by, F.col("_t").alias("_j"), every.alias("_i"))
    far = F.levenshtein("_na", "_nc") / F.greatest(F.length("_na"), F.length("_nc"), F.lit(1))
    links = left.join(right, [*by, "_i", "_j"]).where((F.col("_a") < F.col("_c")) & (1 - far >= least)).select("_a", "_c")
    return components(links.union(same), "_a", "_c")


def merged(facts: DataFrame, roots: DataFrame, key: str, drop: bool) -> DataFrame:
    """Facts after a merge: those of merged entities point to the entity that stays, or go if drop."""
    gone = roots.where("id <> root").select(F.col("id").alias(key), F.col("root").alias("_root"))
    if drop:
        return facts.join(gone, key, "left_anti").select(*facts.columns)
    return facts.join(gone, key, "left").withColumn(key, F.coalesce("_root", F.col(key))).select(*facts.columns)


#: Tables whose rows of a merged entity go, and those whose rows move to the one that stays.
DROPPING, MOVING = ("feature_store", "backtest_holdout"), ("entity_links", "companies", "evaluations", "investments", "anti_portfolio", "deal_funnel")


def resolved(merges: DataFrame, keep: str = "keep_id", merge: str = "merge_id") -> DataFrame:
    """(id, root) of merged entities with chains followed to their end: each round every id jumps to where its target goes, so a
    chain of n takes log n rounds. Of several targets of one id the least counts; a circle raises."""
    links = merges.where(f"{keep} <> {merge}").groupBy(F.col(merge).alias("id")).agg(F.min(keep).alias("root")).checkpoint()
    for _ in range(64):
        ahead = links.select(F.col("id").alias("root"), F.col("root").alias("_next"))
        step = links.join(ahead, "root", "left").select("id", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")).checkpoint()
        if step.where("id = root").limit(1).count():
            raise ValueError("merges go round in a circle")
        links = step.drop("_moved")
        if not step.where("_moved").limit(1).count():
            return links
    raise ValueError("merges go round in a circle")


def merged_tables(tables: dict[str, DataFrame], merges: DataFrame, key: str = "entity_id") -> dict[str, DataFrame]:
    """All tables after the merges: DROPPING ones lose the rows of merged entities, MOVING ones point to the entity that stays, and
    canonical_entities (by id) loses the merged ones. Other tables stay as they are."""
    checkpoints(merges.sparkSession)
    roots, out = resolved(merges), dict(tables)
    for name in DROPPING + MOVING:
        if name in tables:
            out[name] = merged(tables[name], roots, key, name in DROPPING)
    if "canonical_entities" in tables:
        out["canonical_entities"] = tables["canonical_entities"].join(roots.select("id"), "id", "left_anti")
    return out


def left_over(tables: dict[str, DataFrame], merges: DataFrame, key: str = "entity_id") -> dict[str, int]:
    """How many rows of each table still name a merged entity; all 0 after merged_tables()."""
    gone = merges.select(F.col("merge_id").alias("_id")).distinct()
    return {name: df.join(gone, df[key if key in df.columns else "id"] == gone["_id"], "left_semi").count() for name, df in tables.items()}


def grade(f1):
    #: Least F1 of each grade.
    return F.when(f1 >= 0.95, "excellent").when(f1 >= 0.85, "good").when(f1 >= 0.70, "fair").otherwise("poor")
