"""Mixing sources to target weights by hierarchical budgeting (operator 8); DataFrame functions only.

The corpus is a tree: domains, their languages, their sources. A budget of tokens goes down the tree by the children's
weights. A child that cannot use its part (it holds fewer tokens, even in all epochs) leaves the rest to its siblings;
only what no sibling can use returns to the level above, since a node is never given more than its leaves hold. Each
leaf then takes its part from its epochs, one after the other: each epoch is an order of the leaf's documents by the md5
of seed, epoch and id, and the last one is cut to the shortest prefix that fills the part.

The part of a child is found in closed form: children are sorted by capacity / weight, and those that fill up are a prefix.
All arithmetic is in whole numbers.

Tokens are words: runs of characters other than blank, tab and line ends. A domain is a source's name up to its number,
with that number divided by seven ("src8" -> "src/1"); without a number the name is the domain.

Defined results: null text counts as no token and is part of an epoch's prefix as any other row; null lang or source are
"(none)"; rows of one leaf whose order is the same (repeated ids) are taken or left together; a null id counts as the text
"null"; an empty table gives an empty table; other columns pass through, but for those named _epoch, _domain
or _tokens, which are replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import stored

#: Target weights of domains and languages; all others have weight DEFAULT_WEIGHT, as have sources.
DOMAIN_WEIGHTS = {"src/0": 5, "src/1": 3, "src/2": 2}
LANG_WEIGHTS = {"en": 5, "de": 2, "fr": 2, "es": 1}
DEFAULT_WEIGHT = 1
SEED = 17
EPOCHS = 2
#: Parts of an epoch's order whose tokens are summed before one of them is sorted: hex digits of the hash.
DIGITS = 3
#: Leaves up to which their cuts (a row of some 100 bytes each) go to every task; more are joined by a shuffle.
MOST_LEAVES = 100_000
_WORD = "[^ \\t\\n\\r]+"


def domain_of(source: Column) -> Column:
    number = F.regexp_extract(source, "([0-9]+)$", 1)
    return F.when(number == "", source).otherwise(F.concat(F.regexp_replace(source, "[0-9]+$", ""), F.lit("/"), F.floor(number.try_cast("bigint") / 7).cast("string")))


def weight_of(name: Column, weights: Mapping[str, int]) -> Column:
    out = F.lit(DEFAULT_WEIGHT)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("decimal(38,0)")


def divided(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds `part` to rows (parent..., name, weight, capacity, budget): the parent's budget divided by weight, no part
    above its capacity. Whole tokens that rounding leaves go to the last children by name that have room for one."""
    ratio = F.col("capacity").cast("double") / F.col("weight").cast("double")
    by = W.partitionBy(*parent).orderBy(ratio, name)
    down, rest = by.rowsBetween(W.unboundedPreceding, 0), by.rowsBetween(1, W.unboundedFollowing)
    zero = F.lit(0).cast("decimal(38,0)")
    full = children.withColumns({"_held": F.sum("capacity").over(down), "_rest": F.coalesce(F.sum("weight").over(rest), zero)})
    full = full.withColumn("_full", (F.col("_held") - F.col("budget")) * F.col("weight") + F.col("capacity") * F.col("_rest") <= 0)
    group = W.partitionBy(*parent)
    cut = full.withColumns(
        {
            "_left": F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("capacity"))).over(group), zero),
            "_weights": F.coalesce(F.sum(F.when(~F.col("_full"), F.col("weight"))).over(group), zero),
        }
    )
    part = F.when(F.col("_full"), F.col("capacity")).otherwise(F.expr("cast(_left * weight div _weights as decimal(38,0))"))
    return cut.withColumn("part", part).drop("_held", "_rest", "_full", "_left", "_weights")


def budgets(leaves: DataFrame, budget: Column, domain_weights: Mapping[str, int], lang_weights: Mapping[str, int], source_weights: Mapping[str, int]) -> DataFrame:
    """Rows (_domain, _lang, _source, capacity) with `part`, the tokens each leaf is to give."""
    path, out = ["_domain", "_lang", "_source"], None
    for depth, weights in enumerate((domain_weights, lang_weights, source_weights)):
        own, parent = path[: depth + 1], path[:depth]
        level = leaves.groupBy(*own).agg(F.sum("capacity").cast("decimal(38,0)").alias("capacity"))
        level = level.withColumn("weight", weight_of(F.col(own[-1]), weights))
        if out is None:
            all_held = level.agg(F.sum("capacity").cast("decimal(38,0)").alias("_all"))
            level = level.join(F.broadcast(all_held)).withColumn("budget", F.least(budget.cast("decimal(38,0)"), "_all")).drop("_all").withColumn("_root", F.lit(0))
            out = divided(level, ["_root"], own[-1]).drop("_root")
        else:
            level = level.join(out.select(*parent, F.col("part").alias("budget")), parent)
            out = divided(level, parent, own[-1])
    return out


def mix(
    documents: DataFrame,
    share: tuple[int, int] = (1, 1),
    epochs: int = EPOCHS,
    seed: int = SEED,
    domain_weights: Mapping[str, int] = DOMAIN_WEIGHTS,
    lang_weights: Mapping[str, int] = LANG_WEIGHTS,
    source_weights: Mapping[str, int] | None = None,
    digits: int = DIGITS,
) -> DataFrame:
    """The documents taken, once for each epoch that takes them, with _epoch (from 1), _domain and _tokens beside their
    columns. The budget is share (a numerator and a denominator) of the corpus's tokens."""
    source, lang = F.coalesce(F.col("source").cast("string"), F.lit("(none)")), F.coalesce(F.col("lang").cast("string"), F.lit("(none)"))
    order = lambda epoch: F.md5(F.concat_ws(":", F.lit(seed).cast("string"), epoch.cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    leaf = ["_domain", "_lang", "_source"]
    count = F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long")
    columns = [c for c in documents.columns if c not in ("_epoch", "_domain", "_tokens")]
    whole = F.struct(*columns).alias("_row")  # in a struct the table's names clash with none here
    named = documents.select(whole, "doc_id", "text", domain_of(source).alias("_domain"), lang.alias("_lang"), source.alias("_source"))
    sized = stored(named.select("doc_id", *leaf, count.alias("_tokens")))  # whole texts are read here and at the end
    every = F.explode(F.sequence(F.lit(1), F.lit(epochs))).alias("_epoch")
    keyed = sized.select("*", every).withColumn("_key", order(F.col("_epoch")))
    sums = keyed.groupBy(*leaf, "_epoch", F.substring("_key", 1, digits).alias("_bucket")).agg(F.sum("_tokens").alias("tokens"))
    leaves = sums.groupBy(*leaf).agg(F.sum("tokens").alias("capacity"))
    budget = F.expr(f"cast(_all * {share[0]} div ({share[1]} * {epochs}) as decimal(38,0))")
    parts = budgets(leaves, budget, domain_weights, lang_weights, source_weights or {})
    # the bucket in which a leaf's part ends, and what is left of the part there; a leaf has at most 16 ** digits sums an
    # epoch, however many documents it holds
    w = W.partitionBy(*leaf).orderBy("_epoch", "_bucket").rowsBetween(W.unboundedPreceding, -1)
    run = sums.withColumn("_before", F.coalesce(F.sum("tokens").over(w), F.lit(0))).join(parts.select(*leaf, "part"), leaf)
    ends = run.where((F.col("_before") < F.col("part")) & (F.col("_before") + F.col("tokens") >= F.col("part")))
    ends = ends.select(*leaf, F.col("_epoch").alias("_end"), F.col("_bucket").alias("_end_bucket"), (F.col("part") - F.col("_before")).alias("_open"))
    # inside that bucket alone, documents in order until the part is full
    keys = keyed.join(ends, leaf).where((F.col("_epoch") == F.col("_end")) & (F.substring("_key", 1, digits) == F.col("_end_bucket")))
    keys = keys.groupBy(*leaf, "_end", "_open", "_key").agg(F.sum("_tokens").alias("tokens"))
    inside = W.partitionBy(*leaf).orderBy("_key").rowsBetween(W.unboundedPreceding, -1)
    cut = keys.where(F.col("_open") > 0).withColumn("_before", F.coalesce(F.sum("tokens").over(inside), F.lit(0))).where(F.col("_before") < F.col("_open"))
    cuts = stored(cut.groupBy(*leaf, "_end").agg(F.max("_key").alias("_last")))
    if cuts.count() <= MOST_LEAVES:
        cuts = F.broadcast(cuts)
    taken = named.join(cuts, leaf).select("_row", "doc_id", "_domain", count.alias("_tokens"), "_end", "_last", every)
    return taken.where((F.col("_epoch") < F.col("_end")) | (F.col("_epoch") == F.col("_end")) & (order(F.col("_epoch")) <= F.col("_last"))).select("_row.*", "_epoch", "_domain", "_tokens")


def _divided_sql(rows: str, parent: str) -> str:
    """divided() in SQL over a query with columns name, weight, capacity, budget and the parent's."""
    by = f"PARTITION BY {parent} ORDER BY capacity::DOUBLE / weight::DOUBLE, name"
    return f"""(SELECT *, CASE WHEN is_full THEN capacity ELSE (rest * weight) // nullif(weights, 0) END AS part FROM (
      SELECT *, budget - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY {parent}), 0)::HUGEINT AS rest,
             coalesce(sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {parent}), 0)::HUGEINT AS weights
      FROM (SELECT *, ((sum(capacity) OVER ({by} ROWS UNBOUNDED PRECEDING))::HUGEINT - budget) * weight
                      + capacity * coalesce(sum(weight) OVER ({by} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)::HUGEINT <= 0 AS is_full
            FROM ({rows}))))"""


def mix_sql(share=(1, 1), epochs=EPOCHS, seed=SEED, domain_weights=DOMAIN_WEIGHTS, lang_weights=LANG_WEIGHTS) -> str:
    """The same result as columns doc_id, domain, lang, source, epoch, n_tokens in SQL."""
    weight = lambda col, by: "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in by.items()) + f" ELSE {DEFAULT_WEIGHT} END::HUGEINT" if by else f"{DEFAULT_WEIGHT}::HUGEINT"
    level1 = f"SELECT domain, domain AS name, 0 AS root, {weight('domain', domain_weights)} AS weight, capacity, (sum(capacity) OVER ())::HUGEINT * {share[0]} // ({share[1]} * {epochs}) AS budget FROM (SELECT domain, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY 1)"
    level2 = f"SELECT l.domain, l.lang, l.lang AS name, {weight('l.lang', lang_weights)} AS weight, l.capacity, d.part AS budget FROM (SELECT domain, lang, sum(capacity)::HUGEINT AS capacity FROM leaves GROUP BY 1, 2) l JOIN by_domain d ON l.domain = d.domain"
    level3 = "SELECT s.domain, s.lang, s.source, s.source AS name, 1::HUGEINT AS weight, s.capacity, l.part AS budget FROM leaves s JOIN by_lang l ON s.domain = l.domain AND s.lang = l.lang"
    return f"""
    WITH docs AS (SELECT doc_id, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
                         len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+'))::BIGINT AS n_tokens FROM documents),
    named AS (SELECT *, CASE WHEN regexp_extract(source, '([0-9]+)$', 1) = '' THEN source
              ELSE regexp_replace(source, '[0-9]+$', '') || '/' || (regexp_extract(source, '([0-9]+)$', 1)::BIGINT // 7)::VARCHAR END AS domain FROM docs),
    leaves AS (SELECT domain, lang, source, (sum(n_tokens) * {epochs})::HUGEINT AS capacity FROM named GROUP BY 1, 2, 3),
    by_domain AS {_divided_sql(level1, 'root')},
    by_lang AS {_divided_sql(level2, 'domain')},
    by_source AS {_divided_sql(level3, 'domain, lang')},
    keyed AS (SELECT n.*, e.epoch, b.part, md5('{seed}:' || e.epoch || ':' || coalesce(n.doc_id::VARCHAR, 'null')) AS k
              FROM named n JOIN by_source b ON n.domain = b.domain AND n.lang = b.lang AND n.source = b.source, (SELECT unnest(range(1, {epochs} + 1)) AS epoch) e),
    run AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY epoch, k RANGE UNBOUNDED PRECEDING), 0)
                      - sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch, k) AS before FROM keyed)
    SELECT doc_id, domain, lang, source, epoch::INTEGER AS epoch, n_tokens FROM run WHERE before < part
    """
