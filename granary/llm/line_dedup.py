"""Line dedup by content-defined chunks (operator 7); DataFrame functions only.

A text is cut into chunks of lines. A rolling hash over the hashes of each two lines in a row closes a chunk where it is
divisible by `spacing`, so an inserted or changed line moves no boundary but its own. A chunk of two lines or more that
occurs anywhere before marks the run of lines that it is in; the run is followed line by line to both its ends, as far as
each two lines in a row (white space or marks alone between them count as part) occur anywhere before. All lines of such a run go.
A repeated run that no whole chunk happens to lie in goes too if it has two lines and `passage_words` words or more; shorter ones,
such as two short lines in a row, stay. Single lines stay, unless a caller names `long_words`: then a line of so many words
is a chunk by itself. The first place by id, position and length keeps its lines, also where a later
one overlaps it.

Hashes only find the candidates: what has a hash of its own drops out, the texts of the rest are grouped, and so compared
byte by byte; texts that differ under one hash are each a group of their own. Hashes that many places share are joined
apart from the others, so no common chunk's places meet in one task. Work grows with the lines of a text: a text is cut once in
each step, and lines are cut out as the ranges that stay.

Defined results: null text stays null and has no lines; rows that repeat both id and text count as one document and get the
same result; chunks without a letter or digit are never removed; a null id sorts first; an empty table gives an empty
table; other columns pass through, but for one named _removed, which is replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import forget, join_by_key, stored

#: One of so many line pairs closes a chunk.
SPACING = 4
#: Words from which on a repeated run of lines is a passage, though no chunk lies in it.
PASSAGE_WORDS = 50
#: The registered query's and the pipeline's choice: words from which on a single line is a passage.
LONG_WORDS = 40
_LETTER = "[\\p{L}\\p{N}]"
_NO_RANGE = "array<struct<s:int,e:int,whole:boolean,w:int,last:int>>"


def line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line), 1, 7), 16, 10).cast("long")


def _words(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once for a row, though use may ask for it in loops."""
    return F.transform(F.array(value), use)[0]


def span(lines: Column, x: Column) -> Column:
    """The text of lines s to e."""
    return F.array_join(F.slice(lines, x["s"], x["e"] - x["s"] + 1), "\n")


def spans(lines: Column, spacing: int, long_words: int | None) -> Column:
    """(s, e, whole, w, last) from 1: the chunks of two lines or more and long lines (whole), and from each line with a letter or digit
    to the next one, with the words of its first and last line."""
    piece = lambda s, e, whole, w, last: F.struct(s.cast("int").alias("s"), e.cast("int").alias("e"), F.lit(whole).alias("whole"), w.cast("int").alias("w"), last.cast("int").alias("last"))
    none = F.lit(0)

    def chunks(hashes: Column) -> Column:
        n = F.size(hashes)
        before = F.concat(F.array(F.lit(0).cast("long")), hashes)  # one longer; the end is filled up with a null
        closes = F.transform(F.zip_with(before, hashes, lambda a, b: F.pmod(a * 31 + b, F.lit(spacing)) == 0), lambda x, i: F.when((x & (i > 0)) | (i == n - 1), i + 1))
        return let(F.filter(closes, lambda x: x.isNotNull()), lambda ends: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.greatest(F.size(ends) - 1, none))), ends, lambda a, b: piece(a + 1, b, True, none, none)))

    whole = F.filter(let(F.transform(lines, line_hash), chunks), lambda x: (x["e"] > x["s"]) & span(lines, x).rlike(_LETTER))
    full = F.filter(F.transform(lines, lambda x, i: F.when(x.rlike(_LETTER), F.struct((i + 1).alias("i"), _words(x).alias("w")))), lambda x: x.isNotNull())
    pairs = let(full, lambda f: F.when(F.size(f) > 1, F.zip_with(F.slice(f, 1, F.size(f) - 1), F.slice(f, 2, F.size(f) - 1), lambda a, b: piece(a["i"], b["i"], False, a["w"], b["w"]))).otherwise(F.array().cast(_NO_RANGE)))
    if not long_words:
        return F.concat(whole, pairs)
    alone = F.filter(F.transform(lines, lambda x, i: F.when((_words(x) >= long_words) & x.rlike(_LETTER), piece(i + 1, i + 1, True, none, none))), lambda x: x.isNotNull())
    return F.concat(whole, alone, pairs)


def dedup(documents: DataFrame, spacing: int = SPACING, passage_words: int | None = PASSAGE_WORDS, long_words: int | None = None) -> DataFrame:
    """Every row with its text without the repeated runs of lines, and _removed (lines) beside its columns."""
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    others = [c for c in documents.columns if c not in ("text", "_removed")]  # in a struct their names clash with none here
    rows = documents.select(F.struct(*others).alias("_row"), "text", order.alias("_id"), F.xxhash64("doc_id", "text").alias("_k"))
    columns = [c for c in documents.columns if c != "_removed"]
    own = lambda text: [text.alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns]
    in_lines = lambda use: let(F.split("text", "\n", -1), use)
    place = ["_id", "_k", "s", "e"]

    hashes = lambda lines: F.transform(spans(lines, spacing, long_words), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["whole"].alias("whole"), x["w"].alias("w"), x["last"].alias("last"), F.xxhash64(span(lines, x), x["whole"]).alias("h")))
    hashed = stored(rows.where("text is not null").select("_id", "_k", F.explode(in_lines(hashes)).alias("_c")).select("_id", "_k", "_c.*"))
    shared = hashed.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    held = stored(join_by_key(hashed, shared, "h", F.col("n"), hashed.count()).select(*place, "whole", "w", "last", "h").distinct())
    forget(hashed)
    # the one time that whole documents move; those without a candidate are done
    marked = stored(rows.join(held.groupBy("_id", "_k").agg(F.collect_list(F.struct("s", "e", "whole", "h")).alias("_at")), ["_id", "_k"], "left"))
    some = marked.where("_at is not null")
    with_text = lambda lines: F.transform("_at", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["whole"].alias("whole"), x["h"].alias("h"), span(lines, x).alias("_text")))
    texts = some.select("_id", "_k", F.explode(in_lines(with_text)).alias("_c")).select("_id", "_k", "_c.*")
    # the texts themselves are the key: equal bytes and nothing else fall together
    groups = stored(texts.groupBy("h", "whole", "_text").agg(F.min(F.struct(*place)).alias("_first"), F.count("*").alias("n")))
    by_hash = stored(groups.groupBy("h").agg(F.count("*").alias("texts"), F.min("_first").alias("_first"), F.sum("n").alias("n")))
    shown = [*place, "whole", "w", "last"]
    repeated = join_by_key(held, by_hash.where("texts = 1"), "h", F.col("n"), held.count()).select(*shown, "_first")
    if by_hash.where("texts > 1").limit(1).count():
        several = texts.join(by_hash.where("texts > 1").select("h"), "h", "left_semi").distinct().join(groups.drop("n"), ["h", "whole", "_text"])
        repeated = repeated.union(held.join(several.select(*place, "whole", "h", "_first"), [*place, "whole", "h"]).select(*shown, "_first"))
    repeated = repeated.where(F.struct(*place) != F.col("_first"))
    same = (F.col("_first._id") == F.col("_id")) & (F.col("_first._k") == F.col("_k"))
    since = F.when(same, F.greatest("s", F.col("_first.e") + 1)).otherwise(F.col("s"))
    late = repeated.select("_id", "_k", since.alias("_s"), "e", "whole", (~F.col("whole") & (since == F.col("s"))).alias("_pair"), "w", "last").where("_s <= e")
    # runs: places of a document that share a line, one after the other
    doc = W.partitionBy("_id", "_k").orderBy("_s", "e", "whole")
    reached = F.max("e").over(doc.rowsBetween(W.unboundedPreceding, -1))
    runs = late.withColumn("_new", F.when(F.col("_s") <= reached, 0).otherwise(1)).withColumn("_run", F.sum("_new").over(doc.rowsBetween(W.unboundedPreceding, 0)))
    words = F.sum(F.when(F.col("_pair"), F.col("w")).otherwise(0)) + F.max(F.when(~F.col("whole"), F.struct("e", "last")))["last"]
    runs = runs.groupBy("_id", "_k", "_run").agg(F.min("_s").alias("s"), F.max("e").alias("e"), F.bool_or("whole").alias("_whole"), F.bool_or("_pair").alias("_two"), words.alias("_words"))
    passage = F.col("_whole") | (F.col("_two") & (F.col("_words") >= passage_words) if passage_words else F.lit(False))
    gone = runs.where(passage).groupBy("_id", "_k").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_gone"))

    def left(lines: Column) -> Column:
        starts = F.concat(F.transform("_gone", lambda x: x["s"]), F.array(F.size(lines) + 1))
        stays = F.zip_with(F.concat(F.array(F.lit(0)), F.transform("_gone", lambda x: x["e"])), starts, lambda a, b: F.struct((a + 1).alias("s"), (b - 1).alias("e")))
        return F.array_join(F.flatten(F.transform(F.filter(stays, lambda x: x["e"] >= x["s"]), lambda x: F.slice(lines, x["s"], x["e"] - x["s"] + 1))), "\n")

    text = F.when(F.col("_gone").isNull(), F.col("text")).otherwise(in_lines(left))
    removed = F.aggregate(F.coalesce("_gone", F.array().cast("array<struct<s:int,e:int>>")), F.lit(0), lambda n, x: n + x["e"] - x["s"] + 1)
    changed = some.join(gone, ["_id", "_k"], "left").select(*own(text), removed.alias("_removed"))
    return marked.where("_at is null").select(*own(F.col("text")), F.lit(0).alias("_removed")).union(changed)


def dedup_sql(spacing: int = SPACING, passage_words: int = PASSAGE_WORDS, long_words: int = LONG_WORDS) -> str:
    """The same result as columns doc_id, text, removed in SQL, for ids that do not repeat."""
    return f"""
    WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
    lines AS (SELECT doc_id, i, l[i] AS line, ('0x' || substr(md5(l[i]), 1, 7))::BIGINT AS h, length(l[i]) - length(replace(l[i], ' ', '')) + 1 AS w,
                     regexp_matches(l[i], '[\\p{{L}}\\p{{N}}]') AS is_full FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs)),
    ends AS (SELECT *, lead(i) OVER w IS NULL OR (i > 1 AND (lag(h) OVER w * 31 + h) % {spacing} = 0) AS is_end FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    numbered AS (SELECT *, coalesce(sum(is_end::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM ends),
    spans AS (SELECT doc_id, min(i) AS s, max(i) AS e, true AS whole, 0 AS w, 0 AS w_last FROM numbered GROUP BY doc_id, c HAVING count(*) > 1 AND bool_or(is_full)
              UNION ALL SELECT doc_id, i, i, true, 0, 0 FROM lines WHERE w >= {long_words} AND is_full
              UNION ALL SELECT * FROM (SELECT doc_id, i AS s, lead(i) OVER w AS e, false, w, lead(w) OVER w FROM lines WHERE is_full WINDOW w AS (PARTITION BY doc_id ORDER BY i)) WHERE e IS NOT NULL),
    texts AS (SELECT spans.*, array_to_string(l[s:e], chr(10)) AS t FROM spans JOIN docs USING (doc_id)),
    firsts AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(s) OVER w AS first_s, first_value(e) OVER w AS first_e
               FROM texts WINDOW w AS (PARTITION BY whole, t ORDER BY doc_id, s, e)),
    late AS (SELECT doc_id, CASE WHEN first_id = doc_id THEN greatest(s, first_e + 1) ELSE s END AS f, s, e, whole, w, w_last FROM firsts WHERE (doc_id, s, e) <> (first_id, first_s, first_e)),
    reach AS (SELECT *, max(e) OVER (PARTITION BY doc_id ORDER BY f, e, whole ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM late WHERE f <= e),
    run AS (SELECT *, sum(CASE WHEN f <= m THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY f, e, whole ROWS UNBOUNDED PRECEDING) AS r FROM reach),
    gone AS (SELECT doc_id, unnest(range(min(f), max(e) + 1)) AS i FROM run GROUP BY doc_id, r
             HAVING bool_or(whole) OR (bool_or(NOT whole AND f = s) AND sum(CASE WHEN NOT whole AND f = s THEN w ELSE 0 END) + arg_max(w_last, e) FILTER (NOT whole) >= {passage_words})),
    done AS (SELECT lines.doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.i IS NULL), '') AS text, count(gone.i) AS removed FROM lines LEFT JOIN gone USING (doc_id, i) GROUP BY 1)
    SELECT d.doc_id, done.text, coalesce(done.removed, 0)::INTEGER AS removed FROM documents d LEFT JOIN done ON d.doc_id = done.doc_id
    """
