"""Record linkage without labels: several blocking passes, weights of field agreements by expectation-maximisation, scores
of pairs, clusters with their mean score and merges."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.functions.parsing import normalized_name
from granary.operators.containment import grams
from granary.operators.graph import checkpoints, components

#: Probability from which on a pair is linked, and mean score of a cluster from which on it is merged.
LINKED, MERGED = 0.5, 0.85
#: Records of a tile of a block: a larger block is compared tile by tile. A record is copied for each tile of its block, so tiles are large.
TILE = 8000
#: Min-hashes of a name's grams: so many bands of so many. Words that at most so many records have are rare.
BANDS, ROWS, RARE = 6, 2, 50
#: Steps of the estimate at most, and the change that ends it.
STEPS, STILL = 200, 1e-9


def records(rows: DataFrame, key: str, name: str, fields: list[str]) -> DataFrame:
    """(_id, _n, _f): id, normalised name and lower-case fields of records with a name. Equal ones are one record, the least id's."""
    clean = F.array(*[F.nullif(F.lower(F.trim(F.col(c).cast("string"))), F.lit("")) for c in fields]).cast("array<string>")
    named = rows.select(F.col(key).alias("_id"), normalized_name(F.col(name)).alias("_n"), clean.alias("_f"))
    return named.where(F.col("_id").isNotNull() & (F.col("_n") != ""))


def sound(word: Column) -> Column:
    """A phonetic code of a Latin word; other words stand for themselves."""
    return F.when(word.rlike("^[a-z]"), F.soundex(word)).otherwise(word)


#: Longs of a sketch of a name's pairs of letters.
SKETCH = 4


def bits(parts: Column, at: int, longs: int) -> Column:
    """The long number `at` of a sketch of so many, with a bit for each part by its hash."""
    spot = lambda g: F.pmod(F.xxhash64(g), F.lit(64 * longs)).cast("int")
    one = lambda g: F.when(F.floor(spot(g) / 64) == at, F.call_function("shiftleft", F.lit(1).cast("long"), spot(g) % 64)).otherwise(F.lit(0).cast("long"))
    return F.aggregate(parts, F.lit(0).cast("long"), lambda held, g: held.bitwiseOR(one(g)))


def keyed(recs: DataFrame) -> DataFrame:
    """(_id, _n, _f, _words, _keys, _g0, ..., _w, _most): keys of the sounds of a name's first and last word and of bands of min-hashes of
    its grams, sketches of its pairs of letters and of its words, and the edits at most that leave 0.7 of it."""
    words = F.array_distinct(F.filter(F.split("_n", " "), lambda w: w != ""))
    signs = F.array_distinct(F.concat(grams(F.concat(F.lit(" "), "_n", F.lit(" ")), 3), F.array("_n")))
    # columns of their own: each is computed once, not once for every hash
    made = recs.select("_id", "_n", "_f", F.split("_n", " ").alias("_all"), words.alias("_words"), signs.alias("_signs"), grams(F.col("_n"), 2).alias("_two"))
    least = lambda i: F.array_min(F.transform("_signs", lambda g: F.xxhash64(g, F.lit(i))))
    bands = [F.xxhash64(F.lit(f"m{b}"), *[least(b * ROWS + i) for i in range(ROWS)]) for b in range(BANDS)]
    by_sound = [F.xxhash64(F.lit("s"), sound(F.col("_all")[0])), F.xxhash64(F.lit("e"), sound(F.element_at("_all", -1)))]
    sketches = [*[bits(F.col("_two"), i, SKETCH).alias(f"_g{i}") for i in range(SKETCH)], bits(F.col("_words"), 0, 1).alias("_w")]
    return made.select("_id", "_n", "_f", "_words", F.array(*by_sound, *bands).alias("_keys"), *sketches, F.floor(F.length("_n") * 3 / 10).cast("int").alias("_most"))


def possible() -> tuple[Column, Column]:
    """Whether the letters and the words of a pair's names may agree, by their sketches. An edit takes at most two pairs of letters away, so
    names within `_most` edits lack at most twice as many of each other's; words of which half are common differ in at most a third of both
    counts' sum. Bits that hashes share only lower the differences, so no agreement is lost."""
    lacks = lambda x, y: sum((F.bit_count(F.col(f"{x}._g{i}").bitwiseAND(F.bitwise_not(f"{y}._g{i}"))) for i in range(1, SKETCH)), F.bit_count(F.col(f"{x}._g0").bitwiseAND(F.bitwise_not(f"{y}._g0"))))
    most = 2 * F.greatest("a._most", "b._most")
    return (lacks("a", "b") <= most) & (lacks("b", "a") <= most), F.bit_count(F.col("a._w").bitwiseXOR(F.col("b._w"))) * 3 <= F.col("a._c") + F.col("b._c")


def compared(recs: DataFrame, fields: int, tile: int = TILE, every: bool = False) -> DataFrame:
    """(a, b, again, word, g0, ...): ids, a < b, and agreement of pairs of keyed records that share a key, or else a rare word. Pairs whose names
    surely agree in nothing are left out where they are met (those of a rare word are kept), if not `every`. A pair that shares several keys
    is there once under each, with again set but under the first; word marks those of a rare word. Blocks of more than a tile's records are pairs of tiles, so none is one task."""
    n = 2 + BANDS
    sizes = recs.select(F.explode("_keys").alias("_key")).groupBy("_key").agg(F.count("*").alias("_k")).where("_k > 1").select("_key", F.ceil(F.col("_k") / tile).cast("int").alias("_tiles"))
    own = ["_id", "_n", "_f", *[f"_g{i}" for i in range(SKETCH)], "_w", F.size("_words").alias("_c"), "_most"]
    held = recs.select(F.posexplode("_keys").alias("_r", "_key"), "_keys", *own)
    held = held.select("*", *[F.when(F.col("_r") > i, F.col("_keys")[i]).alias(f"_k{i}") for i in range(n - 1)]).drop("_keys", "_r")
    placed = held.join(sizes, "_key").withColumn("_t", F.pmod(F.xxhash64("_id"), F.col("_tiles")).cast("int"))
    placed = placed.withColumn("_u", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    placed = placed.select("*", (F.least("_t", "_u") * F.col("_tiles") + F.greatest("_t", "_u")).alias("_cell"), (F.col("_t") == F.col("_u")).alias("_own")).drop("_tiles", "_u")
    same = lambda c: F.col(f"a.{c}") == F.col(f"b.{c}")
    letters, words = possible()
    before = same("_k0")
    for i in range(1, n - 1):
        before = before | same(f"_k{i}")
    met = same("_key") & same("_cell") & (F.col("a._id") < F.col("b._id")) & ((F.col("a._own") & F.col("b._own")) | ~same("_t"))  # both sides read the same columns, so they are one shuffle
    pairs = placed.alias("a").join(placed.alias("b"), met if every else met & (letters | words | before))
    pairs = agreement(pairs, fields, F.coalesce(before, F.lit(False))).withColumn("word", F.lit(False))
    word = recs.select(F.explode("_words").alias("_word"), "_keys", *own)
    rare = word.groupBy("_word").agg(F.count("*").alias("_k")).where((F.col("_k") > 1) & (F.col("_k") <= RARE)).drop("_k")
    few = word.join(rare, "_word")
    others = same("_word") & (F.col("a._id") < F.col("b._id")) & ~F.exists(F.zip_with("a._keys", "b._keys", lambda x, y: x == y), lambda x: x)
    # at most RARE records have a rare word, so these pairs grow with the records
    return pairs.unionByName(agreement(few.alias("a").join(few.alias("b"), others), fields, F.lit(False)).distinct().withColumn("word", F.lit(True)))


def agreement(pairs: DataFrame, fields: int, again: Column) -> DataFrame:
    """How far the parts of a pair agree, each in a few levels: the names' letters (3 equal, 2 from 0.85, 1 from 0.7), their words (2 all,
    1 half of them), and each field (1 equal, 0 not, -1 where one is missing)."""
    a, b = F.col("a._n"), F.col("b._n")
    letters, words = possible()
    edits = F.when(letters, F.call_function("levenshtein", a, b, F.greatest("a._most", "b._most"))).otherwise(-1)  # -1: more than these
    x, y = F.split(a, " "), F.split(b, " ")
    share = F.when(words, F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))).otherwise(0.0)
    own = [F.when(F.col("a._f")[i].isNull() | F.col("b._f")[i].isNull(), -1).when(F.col("a._f")[i] == F.col("b._f")[i], 1).otherwise(0).cast("int").alias(f"g{i + 2}") for i in range(fields)]
    made = pairs.select(F.col("a._id").alias("a"), F.col("b._id").alias("b"), again.alias("again"), edits.alias("_e"), F.greatest(F.length(a), F.length(b)).alias("_l"), share.alias("_s"), *own)
    close = 1 - F.col("_e") / F.col("_l")
    level = F.when(F.col("_e") < 0, 0).when(F.col("_e") == 0, 3).when(close >= 0.85, 2).when(close >= 0.7, 1).otherwise(0).cast("int")
    return made.select("a", "b", "again", level.alias("g0"), F.when(F.col("_s") >= 1, 2).when(F.col("_s") >= 0.5, 1).otherwise(0).cast("int").alias("g1"), *[f"g{i + 2}" for i in range(fields)])


def visits(recs: DataFrame, fields: int) -> dict[tuple[int, ...], int]:
    """How many pairs share a key, once for each key that they share, by the agreement of their fields; reckoned from the counts of each
    key's records by field values, without pairs. For a field, pairs lacking it are all less those that have it; pairs that differ
    are those that have it less the equal ones."""
    f = [f"f{i}" for i in range(fields)]
    cells = recs.select(F.explode("_keys").alias("_key"), *[F.col("_f")[i].alias(c) for i, c in enumerate(f)]).groupBy("_key", *f).agg(F.count("*").alias("n"))
    kinds = list(itertools.product("abe", repeat=fields))  # of each field: all pairs, both have it, equal
    sums = []
    for kind in kinds:
        has = F.lit(True)
        for c, k in zip(f, kind, strict=True):
            has = has & (F.lit(True) if k == "a" else F.col(c).isNotNull())
        group = Window.partitionBy("_key", *[c for c, k in zip(f, kind, strict=True) if k == "e"])
        n = F.when(has, F.col("n")).otherwise(0)
        sums.append((n * (F.sum(n).over(group) - 1)).alias("_".join(("v", *kind))))
    row = cells.select(*sums).agg(*[F.sum("_".join(("v", *k))).alias("_".join(("v", *k))) for k in kinds]).first()
    met = {k: (row["_".join(("v", *k))] or 0) // 2 for k in kinds}
    of = {-1: (("a", 1), ("b", -1)), 0: (("b", 1), ("e", -1)), 1: (("e", 1),)}
    return {p: sum(math.prod(s for _, s in t) * met[tuple(k for k, _ in t)] for t in itertools.product(*[of[v] for v in p])) for p in itertools.product(of, repeat=fields)}


def estimate(patterns: dict[tuple[int, ...], int]) -> tuple[float, list[dict[int, float]], list[dict[int, float]]]:
    """The share of matches among pairs, and each part's chances of its levels among matches and among others, by
    expectation-maximisation over the counts of agreement patterns. Missing fields (-1) say nothing. Equal names start as likely matches."""
    n = sum(patterns.values())
    if not n:
        return 0.0, [], []
    width = len(next(iter(patterns)))
    levels = [sorted({p[i] for p in patterns if p[i] >= 0}) for i in range(width)]
    top = [max(x, default=0) for x in levels]
    chance = {p: 0.9 if p[0] >= 2 and all(v < 0 or v == t for v, t in zip(p[1:], top[1:], strict=True)) else 0.6 if p[0] >= 2 else 0.02 for p in patterns}
    share, before = 0.0, -1.0
    for _ in range(STEPS):
        share = sum(chance[p] * k for p, k in patterns.items()) / n
        made = []
        for side in (lambda p: chance[p], lambda p: 1 - chance[p]):
            parts = []
            for i in range(width):
                sums = {v: 0.5 for v in levels[i]}  # half a pair more for each level keeps chances off 0
                for p, k in patterns.items():
                    if p[i] >= 0:
                        sums[p[i]] += side(p) * k
                total = sum(sums.values())
                parts.append({v: x / total for v, x in sums.items()})
            made.append(parts)
        for p in patterns:
            ratio = math.log(max(share, 1e-12) / max(1 - share, 1e-12))
            ratio += sum(math.log(made[0][i][v] / made[1][i][v]) for i, v in enumerate(p) if v >= 0)
            chance[p] = 1 / (1 + math.exp(-max(min(ratio, 500.0), -500.0)))
        if abs(share - before) < STILL:
            break
        before = share
    return share, made[0], made[1]


def scored(recs: DataFrame, fields: int, least: float, tile: int = TILE) -> DataFrame:
    """(a, b, score) of compared pairs of at least that probability to be one entity. Pairs whose names agree in nothing are only counted:
    as all that share a key (visits) less the others. The counts of patterns, at most 12 for each combination of field levels, come to the
    driver."""
    checkpoints(recs.sparkSession)
    cols = [f"g{i}" for i in range(fields + 2)]
    kept = keyed(recs).checkpoint()
    near = ((F.col("g0") > 0) | (F.col("g1") > 0)) & ~F.col("again")
    levels = compared(kept, fields, tile)
    held = levels.groupBy(F.when(near, F.col("a")).alias("a"), F.when(near, F.col("b")).alias("b"), "again", "word", *cols).agg(F.count("*").alias("k")).checkpoint()
    counts = {}
    for p, k in visits(kept, fields).items():
        counts[(0, 0, *p)] = k
    for r in held.groupBy("again", "word", *cols).agg(F.sum("k").alias("k")).collect():
        p = tuple(r[c] for c in cols)
        far = (0, 0, *p[2:])
        if r["word"]:  # shares no key, so no visit
            counts[p] = counts.get(p, 0) + r["k"]
        elif r["again"]:
            counts[far] -= r["k"]
        elif p != far:
            counts[far] -= r["k"]
            counts[p] = counts.get(p, 0) + r["k"]
    counts = {p: k for p, k in sorted(counts.items()) if k}
    share, match, other = estimate(counts)
    ratio = F.lit(math.log(max(share, 1e-12) / max(1 - share, 1e-12)))
    for i, c in enumerate(cols if match else ()):
        weight = F.lit(0.0)
        for v in match[i]:
            weight = F.when(F.col(c) == v, math.log(match[i][v] / other[i][v])).otherwise(weight)
        ratio = ratio + weight
    sure = lambda x: x.select("a", "b", (1 / (1 + F.exp(-ratio))).alias("score")).where(F.col("score") >= least)
    made = sure(held.where("a is not null"))
    rest = recs.sparkSession.createDataFrame([p for p in counts if not any(p[:2])], ", ".join(f"{c} int" for c in cols))
    if sure(rest.select(F.lit(0).alias("a"), F.lit(0).alias("b"), "*")).limit(1).count():  # the estimate links names that agree in nothing: these pairs are made as well
        return made.unionByName(sure(compared(kept, fields, tile, every=True).where("g0 = 0 and g1 = 0 and not again")))
    return made


def linked(rows: DataFrame, key: str, name: str, fields: list[str], least: float = LINKED, tile: int = TILE) -> DataFrame:
    """(a, b, score) of pairs of records that are taken for one entity; records equal in name and fields are linked to the least of them
    with score 1, which alone is compared with others."""
    recs = records(rows, key, name, fields)
    firsts = recs.groupBy("_n", "_f").agg(F.min("_id").alias("_id"))
    same = recs.join(firsts.withColumnRenamed("_id", "a"), ["_n", "_f"]).where(F.col("a") != F.col("_id"))
    pairs = scored(firsts, len(fields), least, tile)
    return pairs.unionByName(same.select("a", F.col("_id").alias("b"), F.lit(1.0).alias("score")))


def clusters(links: DataFrame, least: float = MERGED) -> DataFrame:
    """(id, root, score, merged): connected records with the mean score of their cluster's links, and whether it is merged."""
    roots = components(links, "a", "b")
    mean = links.join(roots, links["a"] == roots["id"]).groupBy("root").agg(F.avg("score").alias("score"))
    return roots.join(mean, "root").select("id", "root", "score", (F.col("score") >= least).alias("merged"))
