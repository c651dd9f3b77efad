"""Source divergence audit over deduplicated count columns (operator 12).

Per language, the terms that at least `least` of its documents have are kept. A source's share of a term, in whole parts
of SCALE, is p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), with N the source's occurrences of kept terms and V the number of these; two shares
differ by f = floor((p - q)^2 / (p + q)). All sources of a language are compared pair by pair, and each with the language as a whole term by term.

Terms with identical counts in all sources give identical values, so they are grouped by their sparse vector of (source,
count), and each pair of sources is evaluated once for each distinct vector and multiplied by the vector's terms. The sum over all
terms for sources s and t, absent ones included, is put together from what each source has alone: over the distinct counts of
s, f against t's share of an absent term, the same the other way, f of two absent shares for all other terms, and a correction
for vectors in which both stand. So the work follows the entries of distinct vectors and the pairs of sources that are
the result; no term is paired with another.

Counts are added up in each task before they are shuffled, hot sources are joined apart, the pairs of sources are spread
over tasks by source, and of each group of equal vectors only the first terms that can be in a report move. Vectors hold one entry for each source.

Defined results: null text, lang and source count as empty strings, which are a language and a source like others; rows
that repeat an id count one by one; a group without terms has the shares of absent terms; without kept terms all pairs have 0
and no term is listed; a language of one source has no pair; an empty table gives an empty table; other columns are
ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import arrow_schema, forget, join_by_key, map_rows, stored, to_arrow

SCALE = 1_000_000_000
#: Documents of a language that a kept term is in, at least, and terms of a report.
LEAST, TOP = 10, 10
#: Counts that a task holds before it sends them on, characters of a text looked at at once.
HELD, SLICE = 500_000, 1 << 20
#: A term's occurrences and documents in one number until they are sent on: documents from this bit on.
_SHIFT = 40
_DOCUMENT = 1 << _SHIFT
#: Tasks that the pairs of one language's sources are spread over, and pairs of entries that are evaluated at once.
SPREAD, AT_ONCE = 32, 1 << 20
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_BREAK = re.compile("[\x00-\x40\x5b-\x60\x7b-\x7f]")


def terms_of(text: str) -> Iterator[list[str]]:
    """The terms of a text with A to Z in small letters; a long text slice by slice, cut between terms."""
    text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    a = 0
    while len(text) - a > SLICE and (m := _BREAK.search(text, a + SLICE)):
        yield TERM.findall(text, a, m.start())
        a = m.start()
    yield TERM.findall(text, a)


def term_counts(documents: DataFrame) -> DataFrame:
    """(lang, source, term, c occurrences, df documents)."""
    empty = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    fields = arrow_schema("lang string, source string, term string, c long, df long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held, size = to_arrow(fields), {}, 0

        def flush() -> pa.RecordBatch:
            parts = [[] for _ in out]
            for (lang, source), own in held.items():
                both = np.fromiter(own.values(), np.int64, len(own))
                columns = (pa.repeat(lang, len(own)), pa.repeat(source, len(own)), pa.array(own.keys(), pa.string()), pa.array(both & (_DOCUMENT - 1)), pa.array(both >> _SHIFT))
                for part, column in zip(parts, columns, strict=True):
                    part.append(column)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.concat_arrays(x) for x in parts], schema=out)

        for batch in batches:
            for lang, source, text in zip(*(batch.column(x).to_pylist() for x in ("lang", "source", "text")), strict=True):
                own = Counter()
                for terms in terms_of(text):
                    own.update(terms)
                if own:
                    sums = held.setdefault((lang, source), {})
                    before, known = len(sums), sums.get
                    for term, n in own.items():
                        sums[term] = known(term, 0) + n + _DOCUMENT
                    size += len(sums) - before
                    if size >= HELD:
                        yield flush()
                        size = 0
        if held:
            yield flush()

    made = documents.select(empty("lang"), empty("source"), empty("text")).mapInArrow(run, fields)
    return made.groupBy("lang", "source", "term").agg(F.sum("c").alias("c"), F.sum("df").alias("df"))


def share(count: Column, n: Column, v: Column) -> Column:
    """p of a count, exact: the product is a decimal of 38 digits, the division whole."""
    whole = lambda x: x.cast("decimal(38,0)")
    return F.when(n + 2 * v > 0, F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * whole(count + 2).cast("decimal(20,0)"), whole(n + 2 * v)) + 1)


def differ(p: Column, q: Column) -> Column:
    """f of two shares; both are at most SCALE + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def corrections(vectors: DataFrame) -> DataFrame:
    """(lang, s, t, value): over vectors in which both sources stand, what their own shares give beyond the shares of absent
    terms. Vectors of one size are evaluated together; each task adds its sums up."""
    fields = "lang string, s string, t string, value long"
    schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, str, str], int] = {}
        out = to_arrow(schema)

        def flush() -> pa.RecordBatch:
            rows = [(*k, v) for k, v in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

        for batch in batches:
            langs, lang_of = _numbered(batch.column("lang"))
            entries = batch.column("vec")
            sizes = np.diff(entries.offsets.to_numpy())
            starts = entries.offsets.to_numpy()[:-1] - entries.offsets[0].as_py()
            flat = entries.flatten()
            names, source = _numbered(flat.field("source"))
            p, none = (flat.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("p", "p0"))
            times = batch.column("times").to_numpy().astype(np.int64)
            for k in np.unique(sizes[sizes > 1]).tolist():
                rows = np.flatnonzero(sizes == k)
                for first in range(k - 1):  # entry `first` with each later one, for as many vectors as fit
                    step = max(1, AT_ONCE // (k - first - 1))
                    for a in range(0, len(rows), step):
                        r = rows[a : a + step]
                        i = starts[r] + first
                        j = (starts[r][:, None] + np.arange(first + 1, k)).ravel()
                        i = np.repeat(i, k - first - 1)
                        value = (_f(p[i], p[j]) - _f(p[i], none[j]) - _f(none[i], p[j]) + _f(none[i], none[j])) * np.repeat(times[r], k - first - 1)
                        key = (np.repeat(lang_of[r], k - first - 1) * len(names) + source[i]) * len(names) + source[j]
                        order = np.argsort(key, kind="stable")
                        key = key[order]
                        cuts = np.flatnonzero(np.diff(key, prepend=-1))
                        for x, v in zip(key[cuts].tolist(), np.add.reduceat(value[order], cuts).tolist(), strict=True):
                            at = (langs[x // len(names) ** 2], names[x // len(names) % len(names)], names[x % len(names)])
                            sums[at] = sums.get(at, 0) + v
                if len(sums) >= HELD:
                    yield flush()
        if sums:
            yield flush()

    return vectors.select("lang", "vec", "times").mapInArrow(run, schema)


def _numbered(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct strings and the number of each row's."""
    coded = column.dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def audit(documents: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): `pair` rows for each other source of the language, `term` rows for the `top`
    terms in which the source lies most above its language."""
    empty = lambda x: F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x)
    counts = stored(term_counts(documents))
    kept = stored(counts.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.sum("c").alias("total")).where(F.col("df") >= least).drop("df"))
    entries = stored(counts.select("lang", "source", "term", "c").join(kept, ["lang", "term"]))
    forget(counts)

    # what each group and each language has in all
    own = entries.groupBy("lang", "source").agg(F.sum("c").alias("n"), F.count("*").alias("has"))
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("total").alias("n_lang"))
    zero = lambda x: F.coalesce(x, F.lit(0)).alias(x)
    groups = documents.select(empty("lang"), empty("source")).distinct().join(own, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = stored(groups.select("lang", "source", zero("n"), zero("has"), zero("v"), zero("n_lang")))

    # one vector for each term, equal ones together
    group = F.struct("lang", "source").alias("g")
    sizes = groups.select(group, "n", "v", "n_lang", "has")
    each = join_by_key(entries.select(group, "term", "c", "total"), sizes, "g", F.col("has"), entries.count())
    none = share(F.lit(0), F.col("n"), F.col("v"))
    each = each.select("g.lang", "g.source", "term", share(F.col("c"), F.col("n"), F.col("v")).alias("p"), none.alias("p0"), share(F.col("total"), F.col("n_lang"), F.col("v")).alias("q"))
    vec = F.array_sort(F.collect_list(F.struct("source", "p", "p0", "q"))).alias("vec")
    terms = each.groupBy("lang", "term").agg(vec)
    # a hash of the vector stands before it in keys: sorts then seldom look at vectors, which decide all the same
    terms = stored(terms.withColumn("vk", F.xxhash64("vec")))
    forget(entries)
    vectors = stored(terms.groupBy("vk", "lang", "vec").agg(F.count("*").alias("times"), F.min("term").alias("first")))

    # pairs of sources
    alone = vectors.select("lang", "times", F.explode("vec").alias("x")).groupBy("lang", "x.source", "x.p").agg(F.sum("times").alias("times"))
    counts_of = alone.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "times")).alias("own"))
    sides = groups.select("lang", "source", "v", "has", none.alias("p0")).join(counts_of, ["lang", "source"], "left")
    s = sides.select("lang", F.col("source").alias("s"), "v", "has", F.col("p0").alias("none_s"), F.col("own"), F.pmod(F.xxhash64("source"), F.lit(SPREAD)).alias("_spread"))
    t = groups.select("lang", F.col("source").alias("t"), F.col("has").alias("has_t"), none.alias("none_t"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SPREAD - 1).cast("long"))).alias("_spread"))
    grid = s.join(t, ["lang", "_spread"]).where("s <> t")
    against = F.aggregate(F.coalesce("own", F.array().cast("array<struct<p:bigint,times:bigint>>")), F.lit(0).cast("long"), lambda done, x: done + x["times"] * differ(x["p"], F.col("none_t")))
    others = (F.col("v") - F.col("has") - F.col("has_t")) * differ(F.col("none_s"), F.col("none_t"))
    grid = stored(grid.select("lang", "s", "t", F.when(F.col("v") > 0, against).otherwise(0).alias("against"), F.when(F.col("v") > 0, others).otherwise(0).alias("others")))
    turned = lambda df, value: df.select("lang", F.col("t").alias("s"), F.col("s").alias("t"), value.alias("value"))
    both = corrections(vectors)
    parts = grid.select("lang", "s", "t", (F.col("against") + F.col("others")).alias("value")).union(turned(grid, F.col("against")))
    parts = parts.union(both).union(turned(both, F.col("value")))
    pairs = parts.groupBy("lang", F.col("s").alias("source"), F.col("t").alias("item")).agg(F.sum("value").alias("value"))
    ranked = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int").alias("rank")
    columns = ["lang", "source", F.lit("pair").alias("part"), "item", "value"]
    pairs = pairs.select(*columns, ranked)

    # terms above the language: of a group the first vectors, of each vector the first terms, then the first of these
    above = vectors.select("vk", "lang", "vec", "first", F.explode("vec").alias("x")).where("x.p > x.q").select("vk", "lang", "vec", "first", "x.source", differ(F.col("x.p"), F.col("x.q")).alias("value"))
    by = W.partitionBy("lang", "source")
    best = stored(above.withColumn("_r", F.row_number().over(by.orderBy(F.desc("value"), "first"))).where(F.col("_r") <= top).drop("_r", "first"))
    asked = terms.join(best.select("vk", "lang").distinct(), ["vk", "lang"], "left_semi")
    heads = asked.withColumn("_r", F.row_number().over(W.partitionBy("vk", "lang", "vec").orderBy("term"))).where(F.col("_r") <= top).select("vk", "lang", "vec", "term")
    named = best.join(heads, ["vk", "lang", "vec"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    listed = named.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item")).cast("int")).where(F.col("rank") <= top)
    return pairs.union(listed)


def audit_sql(least: int = LEAST, top: int = TOP) -> str:
    """The same rows in SQL, each term with each source."""
    return f"""
    WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
    occ AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS total FROM occ GROUP BY 1, 2 HAVING count(DISTINCT id) >= {least}),
    vs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY 1),
    cnt AS (SELECT lang, source, term, count(*) AS c FROM occ SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
    ns AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY 1, 2),
    g AS (SELECT DISTINCT lang, source FROM d),
    p AS (SELECT g.lang, g.source, kept.term, coalesce(c, 0) AS c, 1 + ({SCALE}::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(ns.n, 0) + 2 * vs.v) AS p,
                 1 + ({SCALE}::HUGEINT * (total + 2)) // (vs.n + 2 * vs.v) AS q
          FROM g JOIN kept USING (lang) JOIN vs USING (lang) LEFT JOIN ns ON ns.lang = g.lang AND ns.source = g.source
          LEFT JOIN cnt ON cnt.lang = g.lang AND cnt.source = g.source AND cnt.term = kept.term),
    pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
    parts AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                     LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
              UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::BIGINT FROM p WHERE c > 0 AND p > q)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts) WHERE part = 'pair' OR rank <= {top}
    """
