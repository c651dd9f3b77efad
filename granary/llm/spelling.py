"""Grouping of spelling variants by letter-parity bitmask bands (operator 11).

A word's mask has one bit for each letter, set if the word has it an odd number of times. An inserted or deleted letter turns one bit,
a replaced letter two, so of three bands of bits one at least is equal in two near words. Words are grouped
by band, the band's bits and length (each word once as a word of that length and once as one that is a letter shorter than the words it
meets). Masks that differ in one or two bits are candidates, which are verified letter by letter. So that no task looks at all
pairs of a group, only words that share the letters before or after their middle, as one edit leaves one of these halves, are
compared. A pair belongs to the first band in which its words agree.

Bits are dealt to the bands by how even each letter's parities are, so the bands tell words apart alike. A group of more than
GROUP words is cut again by three bands of the bits left, CUTS times at most, which keeps every pair. What is too large
then, as its words have few masks, is dealt to tiles, and each two tiles are compared.

Of near words the one with the largest count, the first in code-point order of ties, is a word's form if it is `times` as
frequent. Counts grow by that factor along forms, so a root is a few steps away and steps are doubled until all are there.

Defined results: null and empty texts have no words; a null id counts as an empty string in the checksum; rows that repeat
an id count one by one; an empty table gives an empty table; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import arrow_schema, forget, join_by_key, map_groups, map_rows, stored, to_arrow

#: Letters of a word at least, its occurrences at least, by how much a form is more frequent, and in how many runs one loses a letter.
SHORTEST, OFTEN, TIMES, SLIPS = 7, 2, 10, 31
#: Words of a group that one task compares, how often larger groups are cut by bands (each time three copies of their rows), and
#: letters compared at once.
GROUP, CUTS, AT_ONCE = 50_000, 3, 1 << 22
#: Counts that a task holds before it sends them on, characters of a text looked at at once.
HELD, SLICE = 300_000, 1 << 20
#: The letters: A to Z are made small, the others stay as they are.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
_FIELDS = ("key", "word", "n", "lo", "hi")
_ROW = "key string, word string, n long, lo long, hi long"


def runs_of(text: str, shortest: int) -> Iterator[list[str]]:
    """The runs of at least so many letters, A to Z in small letters; a long text slice by slice, cut between runs."""
    text = text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    find, a = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}").findall, 0
    while len(text) - a > SLICE and (m := _BREAK.search(text, a + SLICE)):
        yield find(text, a, m.start())
        a = m.start()
    yield find(text, a)


def word_counts(documents: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, slips: int = SLIPS) -> DataFrame:
    """(word, n): words of the corpus, with the letter lost that the checksum of id and run says."""
    fields = arrow_schema("word string, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = to_arrow(fields), Counter()

        def flush() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], schema=out)
            held.clear()
            return made

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for found in runs_of(text, shortest) if text else ():
                    for word, n in Counter(found).items():
                        h = zlib.crc32(word.encode(), start)
                        if h % slips == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                            if len(word) < shortest:
                                continue
                        held[word] += n
                    if len(held) >= HELD:
                        yield flush()
        if held:
            yield flush()

    made = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")).mapInArrow(run, fields)
    return made.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def odd_letters(word: str) -> list[str]:
    return [c for c in set(word) if word.count(c) & 1]


def letter_order(words: DataFrame) -> str:
    """The letters, those first whose parities tell most: about half of the words have an odd number of them."""

    def make():
        def of(batch):
            seen = Counter()
            for w in batch.column("word").to_pylist():
                seen.update(odd_letters(w))
            return {"letter": list(seen), "n": list(seen.values())}

        return of

    total = max(words.count(), 1)
    odd = dict(map_rows(words, "letter string, n long", make).groupBy("letter").agg(F.sum("n")).collect())
    return "".join(sorted(LETTERS, key=lambda c: (abs(odd.get(c, 0) / total - 0.5), c)))


def bands(bits: list[int]) -> list[list[int]]:
    return [bits[k::3] for k in range(3)]


def cut(path: list[int]) -> tuple[list[list[int]], list[int]]:
    """Of a path of bands: the bits of the bands before each chosen one, all of which differ where a pair belongs there, and
    the bits left."""
    left, earlier = list(range(len(LETTERS))), []
    for k in path:
        three = bands(left)
        earlier += three[:k]
        left = sorted(x for i, b in enumerate(three) if i != k for x in b)
    return earlier, left


def halves(bits: list[int]) -> tuple[int, int]:
    """A set of bits as two words of 45 bits."""
    return sum(1 << b for b in bits if b < 45), sum(1 << (b - 45) for b in bits if b >= 45)


def keyed(words: DataFrame, order: str) -> DataFrame:
    """(key, word, n, lo, hi): each word under three bands, for its own length and as the shorter one. A key is the longer
    length, then band and bits of each cut."""

    def make():
        bit = {c: 1 << i for i, c in enumerate(order)}
        masks = [sum(1 << b for b in band) for band in bands(list(range(len(order))))]
        low = (1 << 45) - 1

        def of(batch):
            out = {"key": [], "word": [], "n": [], "lo": [], "hi": []}
            for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
                mask = 0
                for c in odd_letters(word):
                    mask |= bit[c]
                size = len(word)
                for k, band in enumerate(masks):
                    value = f"/{k}:{mask & band:x}"
                    out["key"] += (f"{size}{value}", f"{size + 1}{value}")
                out["word"] += [word] * 6
                out["n"] += [n] * 6
                out["lo"] += [mask & low] * 6
                out["hi"] += [mask >> 45] * 6
            return out

        return of

    return map_rows(words, _ROW, make)


def path_of(key: str) -> list[int]:
    return [int(x[0]) for x in key.split("/")[1:]]


def cut_again(rows: DataFrame) -> DataFrame:
    """Rows of groups that are too large, under three bands of the bits that their key leaves."""

    def make():
        left: dict[tuple[int, ...], list[int]] = {}

        def of(batch):
            out = {x: [] for x in _FIELDS}
            for row in zip(*(batch.column(x).to_pylist() for x in out), strict=True):
                path = tuple(path_of(row[0]))
                if path not in left:
                    left[path] = [sum(1 << b for b in band) for band in bands(cut(list(path))[1])]
                mask = row[3] | row[4] << 45
                for k, band in enumerate(left[path]):
                    for x, v in zip(out, (f"{row[0]}/{k}:{mask & band:x}", *row[1:]), strict=True):
                        out[x].append(v)
            return out

        return of

    return map_rows(rows, _ROW, make)


def tiled(rows: DataFrame, group: int) -> DataFrame:
    """Rows of groups whose words have few masks, dealt to tiles: each two tiles of a group, and each one alone, are a key."""
    tiles = F.ceil(F.col("size") / group).cast("long")
    own = F.pmod(F.crc32(F.col("word").cast("binary")), tiles)
    dealt = rows.withColumn("_t", tiles).withColumn("_own", own).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_t") - 1)))
    key = F.concat("key", F.lit("|"), F.concat_ws(".", "_t", F.least("_own", "_with"), F.greatest("_own", "_with")))
    return dealt.select(key.alias("key"), *_FIELDS[1:])


def tile_of(key: str, names: list[str]) -> np.ndarray | None:
    """Which of a key's two tiles each word is in; None where the key is one whole group or one tile."""
    if "|" not in key:
        return None
    t, a, b = map(int, key.split("|")[1].split("."))
    return None if a == b else np.array([zlib.crc32(w.encode()) % t == b for w in names])


def grouped(words: DataFrame, order: str, group: int = GROUP, cuts: int = CUTS) -> DataFrame:
    """The keyed words, with about `group` of a key at most: larger groups are cut by further bands, and those that are still
    too large then, because their words have few masks, are dealt to tiles."""
    rows, done = stored(keyed(words, order)), None
    for left in range(cuts, -1, -1):
        sizes = stored(rows.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > group))
        if not sizes.limit(1).count():
            break
        hot = join_by_key(rows, sizes, "key", F.col("size"), rows.count())
        small = rows.join(sizes.select("key"), "key", "left_anti")
        done = small if done is None else done.unionByName(small)
        rows = stored(cut_again(hot.drop("size")) if left else tiled(hot, group))
    return rows if done is None else done.unionByName(rows)


def halves_shared(names: list[str], size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of words of `size` letters or one fewer that share the half in which their one edit is not: the letters before
    the middle, or else those after it."""
    middle = (size - 1) // 2
    heads, tails = ({}, {})
    head = np.array([heads.setdefault(w[:middle], len(heads)) for w in names])
    tail = np.array([tails.setdefault(w[middle - size :], len(tails)) for w in names])
    for key, other in ((head, None), (tail, head)):
        order = np.argsort(key, kind="stable")
        at = key[order]
        starts = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        ends = np.append(starts[1:], len(at))
        end, here, d = np.repeat(ends, ends - starts), np.arange(len(at)), 1
        while len(here := here[here + d < end[here]]):
            i, j = order[here], order[here + d]
            if other is not None:
                i, j = i[other[i] != other[j]], j[other[i] != other[j]]
            yield i, j
            d += 1


def one_edit(letters: np.ndarray, size: int, long: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs of rows of a matrix of letters are one edit apart; rows that are not `long` have one letter fewer."""
    out = np.zeros(len(i), bool)
    step = max(1, AT_ONCE // size)
    for a in range(0, len(i), step):
        x, y = i[a : a + step], j[a : a + step]
        swap = ~long[x]
        x, y = np.where(swap, y, x), np.where(swap, x, y)  # x is the longer one
        same = long[x] & long[y]
        good = np.zeros(len(x), bool)
        good[same] = (letters[x[same]] != letters[y[same]]).sum(axis=1) == 1
        other = long[x] & ~long[y]
        p, q = letters[x[other]], letters[y[other]][:, : size - 1]
        head = np.logical_and.accumulate(p[:, :-1] == q, axis=1).sum(axis=1)
        tail = np.logical_and.accumulate((p[:, 1:] == q)[:, ::-1], axis=1).sum(axis=1)
        good[other] = head + tail >= size - 1
        out[a : a + step] = good
    return out


def near_in(table: pa.Table) -> dict:
    """The near words of the words of one key: how many each has there, and the most frequent."""
    key = table.column("key")[0].as_py()
    size, earlier = int(key.split("/")[0]), [halves(band) for band in cut(path_of(key.split("|")[0]))[0]]
    names, n = table.column("word").to_pylist(), table.column("n").to_pylist()
    long, tile = np.array([len(w) == size for w in names]), tile_of(key, names)
    lo, hi = (table.column(x).to_numpy() for x in ("lo", "hi"))
    letters, many, best = None, Counter(), {}
    for i, j in halves_shared(names, size) if long.any() else ():
        a, b = lo[i] ^ lo[j], hi[i] ^ hi[j]
        turned = np.bitwise_count(a) + np.bitwise_count(b)
        good = np.where(turned == 2, long[i] & long[j], (turned == 1) & (long[i] != long[j]))
        for x, y in earlier:
            good &= ((a & x) != 0) | ((b & y) != 0)
        if tile is not None:
            good &= tile[i] != tile[j]
        i, j = i[good], j[good]
        if not len(i):
            continue
        if letters is None:
            letters = np.frombuffer(b"".join([w.encode("latin-1").ljust(size) for w in names]), np.uint8).reshape(len(names), size)
        good = one_edit(letters, size, long, i, j)
        for a, b in zip(i[good].tolist(), j[good].tolist(), strict=True):
            for x, y in ((a, b), (b, a)):
                many[x] += 1
                other = (-n[y], names[y])
                if x not in best or other < best[x]:
                    best[x] = other
    return {"word": [names[x] for x in many], "n_near": list(many.values()), "best": [{"less": best[x][0], "word": best[x][1]} for x in many]}


def near_words(words: DataFrame, group: int = GROUP) -> DataFrame:
    """(word, n_near, best): how many near words a word has and the most frequent of them, as (-n, word)."""
    rows = grouped(words, letter_order(words), group)
    found = map_groups(rows, ["key"], "word string, n_near long, best struct<less:long,word:string>", lambda: near_in)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variants(documents: DataFrame, shortest: int = SHORTEST, often: int = OFTEN, times: int = TIMES, slips: int = SLIPS, group: int = GROUP) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(word_counts(documents, shortest, often, slips))
    near = near_words(words, group)
    is_form = -F.col("best.less") >= times * F.col("n")
    found = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.word")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n"))
    found = stored(found)
    most = found.agg(F.max("n")).first()[0] or 1
    steps = stored(found.where("form is not null").select("word", F.col("form").alias("root"), F.lit(False).alias("there")))
    total = steps.count()
    for _ in range(math.ceil(math.log2(max(math.log(most, times), 1))) + 1 if total else 0):
        # of roots that many words share the next step goes to every task, those of the others by a shuffle
        size = steps.groupBy(F.col("root").alias("word")).agg(F.count("*").alias("size"))
        ahead = steps.join(size, "word").select(F.col("word").alias("root"), F.col("root").alias("next"), "size")
        moved = join_by_key(steps.select("word", "root"), ahead, "root", F.col("size"), total).select("word", "next")
        steps_next = steps.select("word", "root").join(moved, "word", "left").select("word", F.coalesce("next", "root").alias("root"))
        steps_next = stored(steps_next)
        forget(steps)
        steps = steps_next
    roots = steps.select("word", "root")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants_sql(shortest: int = SHORTEST, often: int = OFTEN, times: int = TIMES, slips: int = SLIPS) -> str:
    """The same rows in SQL: words with a letter taken out find their near words, a checksum is folded byte by byte."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"""
    WITH RECURSIVE t AS (SELECT list(v ORDER BY i) AS crc FROM (SELECT i, list_reduce(list_prepend(i::BIGINT, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: {step}) AS v FROM range(256) r(i))),
    r AS (SELECT doc_id, run, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]{{{shortest},}}')) AS run FROM documents) GROUP BY 1, 2),
    b AS (SELECT run, k, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM r),
    h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, d: xor(c >> 8, crc[xor(c & 255, d) + 1]))) AS h FROM b, t),
    w AS (SELECT CASE WHEN h % {slips} = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, k FROM h),
    words AS (SELECT word, sum(k)::BIGINT AS n FROM w WHERE length(word) >= {shortest} GROUP BY 1 HAVING sum(k) >= {often}),
    less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
    near AS (SELECT a.word, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
             UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS other, max(other_n) AS other_n FROM near GROUP BY 1),
    f AS (SELECT words.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= {times} * n THEN other END AS form, CASE WHEN other_n >= {times} * n THEN other_n END AS form_n FROM words LEFT JOIN best ON best.word = words.word),
    up AS (SELECT word, word AS root, form AS next FROM f UNION ALL SELECT up.word, f.word, f.form FROM up JOIN f ON f.word = up.next)
    SELECT f.word, f.form, up.root, f.n, f.n_near, f.form_n FROM f JOIN up ON up.word = f.word AND up.next IS NULL
    """
