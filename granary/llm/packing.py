"""Mixture-controlled packing into fixed token sequences (operator 5).

Each source with a target is a queue of documents, in an order drawn by a hash of id and content; all other sources are
one more queue. A window of `window` tokens grants the queues their target shares of it as credit. A queue sends whole
documents while its credit lasts, and what the last one takes too much is owed from the next window's credit: deficit
round-robin. A queue that is about to end gets no more credit than it can use; the others share the rest by their
targets, so every window is filled as long as there are documents.

In closed form: let v be the credit for each unit of target granted so far. Queue r has then been granted min(total of r,
target of r * v), and their sum says how many windows that is. A document that begins p tokens into queue q is sent in
the window in which v reaches p / target of q. That needs only sums of tokens: of queues, of hash buckets of a queue, and
inside a bucket; so deficits carry over all windows and partitions at once. The windows' documents, one after the other,
fill sequences of `size` tokens without gaps; a document is cut where a sequence ends. Only the last one has padding.

Targets are relative: {"a": 0.3, "b": 0.2} leaves 0.5 to all other sources, {"a": 5, "b": 3} gives these the least of the
named. Without targets each source's is its share of all tokens, so that all queues last until the end.

Defined results: null text counts as empty and gives its closing id alone; a null source is a source of its own; a source
with a target but no documents takes no part; rows that repeat an id are packed one by one; an empty table gives no
pieces; other columns are ignored. Rows in another order or other files give the same pieces.
"""

from __future__ import annotations

import array
import functools
import math
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import map_rows, stored

SIZE = 2048
WINDOW = 32 * SIZE
CLOSING = 1
#: The registered mixture: these sources' shares of every window, the rest is for all others.
TARGETS = {"src0": 0.1, "src1": 0.08, "src2": 0.06, "src3": 0.04}
#: A queue of n tokens has sqrt(n) / SPREAD hash buckets. A bucket's documents are sorted in one task, and so are a
#: queue's buckets; both grow with the root of the input alone.
SPREAD = 8
#: Queues at most where no targets are given: beyond the largest sources the others are one queue.
MOST_QUEUES = 10_000
#: Windows whose sums are added up in one task.
SPAN = 1024


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Characters of plain texts, about whose kinds this module and the tokenizer agree.
_PLAIN = [chr(i) for i in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x250), *range(0x2010, 0x2028))]
#: Distinct pieces whose ids a task remembers, twice over, the characters of the longest of them, and those of a text
#: that are cut into pieces at once.
HELD, LONGEST, SLICE = 400_000, 64, 1 << 20


def splitter() -> re.Pattern:
    """The byte-level pre-tokenizer's pieces of a plain text: contractions, words, numbers, marks and white space."""
    of = lambda kind: "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)
    letter, digit, space = of("L"), of("N"), "".join(re.escape(c) for c in _PLAIN if c.isspace())
    return re.compile(f"'(?:[smtd]|ll|ve|re)| ?[{letter}]+| ?[{digit}]+| ?[^{space}{letter}{digit}]+|[{space}]+(?![^{space}])|[{space}]+")


class Held(dict):
    """piece -> its ids as bytes. What has not been asked for while HELD others came is forgotten."""

    def __init__(self, ids_of: Callable[[str], bytes]):
        self.ids_of, self.older = ids_of, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece) or self.ids_of(piece)
        if len(piece) <= LONGEST:
            if len(self) >= HELD:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


_BETWEEN = re.compile("(?<=[a-z]) (?=[a-z])")


def parts_of(text: str, size: int) -> Iterator[str]:
    """The text in parts of about `size` characters, cut where a word ends and a blank and a word follow: never in a piece."""
    a = 0
    while len(text) - a > size and (m := _BETWEEN.search(text, a + size)):
        yield text[a : m.start()]
        a = m.start()
    yield text[a:] if a else text


def byte_letters() -> dict[int, int]:
    """The byte-level alphabet: printable bytes other than blanks and the soft hyphen stand for themselves, the others for
    the characters from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(others)}


@functools.cache
def encoder(vocab: str):
    """(text -> ids of the tokenizers file as bytes, their type). Ids never reach over the pre-tokenizer's pieces, so a
    plain text is cut into these and tokenizers is asked for each distinct one; it gets every other text whole."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocab)
    kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
    added = [re.escape(t.content) for t in tokenizer.get_added_tokens_decoder().values()]
    odd = re.compile("|".join([f"[^{''.join(map(re.escape, _PLAIN))}]", *added]))
    ids_of = lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, kind).tobytes()
    model, letters, code = tokenizer.model, byte_letters(), "H" if kind == "<u2" else "I"

    def ids_of_piece(piece: str) -> bytes:
        """As ids_of, by the tokenizer's model alone, since a piece is not cut again."""
        ids = array.array(code, [x.id for x in model.tokenize(piece.encode().decode("latin-1").translate(letters))])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    split, held = splitter(), Held(ids_of_piece)

    def encode(text: str) -> bytes:
        if odd.search(text):
            return ids_of(text)
        return b"".join([b"".join(map(held.__getitem__, split.findall(part))) for part in parts_of(text, SLICE)])

    return encode, kind


def tokenized(documents: DataFrame, vocab: str | None = None, closing: int = CLOSING) -> DataFrame:
    """uid (one for each row), h (the order of queues), doc_id, source, n (tokens with the closing id) and ids (little-endian:
    two bytes each if the vocabulary fits, else four), stored."""
    vocab = vocab or vocabulary("byte_bpe_50k.json")

    def make():
        encode, kind = encoder(vocab)
        last = np.array([closing], kind).tobytes()

        def of(batch):
            ids = [encode(t or "") + last for t in batch.column("text").to_pylist()]
            return {"doc_id": batch.column("doc_id"), "source": batch.column("source"), "n": [len(x) // len(last) for x in ids], "ids": ids}

        return of

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), F.col("source").cast("string").alias("source"))
    made = map_rows(rows, "doc_id long, source string, n long, ids binary", make)
    return stored(made.select("*", F.monotonically_increasing_id().alias("uid"), F.xxhash64("doc_id", "ids").alias("h")))


def before(df: DataFrame, key: str, bucket: str, order: list[str], value: str) -> DataFrame:
    """Adds `before`: the sum of value over the earlier rows of the same key, by bucket and then by order. Sums of buckets
    are added up first, so no task gets more than a bucket's rows."""
    sums = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"))
    w = W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    bases = sums.select(key, bucket, F.coalesce(F.sum("_sum").over(w), F.lit(0)).alias("_base"))
    inside = W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0))).join(bases, [key, bucket]).withColumn("before", F.col("before") + F.col("_base")).drop("_base")


class Schedule:
    """How many tokens all queues have been granted when each unit of target has been granted v."""

    def __init__(self, totals: list[float], targets: list[float]):
        self.totals, self.targets = np.asarray(totals, float), np.asarray(targets, float)
        ends = self.totals / self.targets
        by = np.argsort(ends, kind="stable")
        self.ends = ends[by]
        self.ended = np.concatenate(([0.0], np.cumsum(self.totals[by])))
        self.active = np.concatenate((np.cumsum(self.targets[by][::-1])[::-1], [0.0]))

    def granted(self, v: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.ends, v, "left")
        return self.ended[k] + self.active[k] * v

    def window(self, queue: np.ndarray, begins: np.ndarray, size: int) -> np.ndarray:
        """The window that sends a document that begins so many tokens into its queue."""
        return np.floor(self.granted(begins / self.targets[queue]) / size).astype(np.int64)


def queues(tokens: DataFrame, shares: dict[str | None, float] | None) -> tuple[list[tuple[str | None, int, float]], int, float]:
    """(source, tokens, target) of each queue of one source, MOST_QUEUES or those of shares; tokens and target of all others."""
    sums = tokens.groupBy("source").agg(F.sum("n").alias("n"))
    total = sums.agg(F.sum("n")).first()[0] or 0
    if shares is None:
        named = [(r.source, r.n, float(r.n)) for r in sums.orderBy(F.desc("n"), "source").limit(MOST_QUEUES).collect()]
    else:
        if any(not v > 0 for v in shares.values()):
            raise ValueError("targets must be above zero")
        own = F.col("source").isin([x for x in shares if x is not None]) | (F.col("source").isNull() & F.lit(None in shares))
        named = [(r.source, r.n, float(shares[r.source])) for r in sums.where(own).collect()]
    rest = total - sum(n for _, n, _ in named)
    if shares is None:
        return named, rest, float(rest)
    left = 1 - sum(shares.values())
    return named, rest, left if left > 1e-9 else min(shares.values())


def placed(tokens: DataFrame, shares: dict[str | None, float] | None = None, window: int = WINDOW, spread: int = SPREAD) -> DataFrame:
    """uid, n, window and at (tokens before it in the whole output) of rows (uid, h, source, n)."""
    named, rest, rest_target = queues(tokens, shares)
    granted = [(n, t) for _, n, t in named] + [(rest, rest_target)] * (rest > 0) or [(1, 1.0)]
    schedule = Schedule(*zip(*granted, strict=True))
    many = lambda n: math.isqrt(n) // spread + 1
    names = tokens.sparkSession.createDataFrame([(s, i, many(n)) for i, (s, n, _) in enumerate(named)], "name string, queue int, buckets long")
    rows = tokens.select("uid", "source", "n", "h").join(F.broadcast(names), F.col("source").eqNullSafe(F.col("name")), "left")
    buckets = F.coalesce("buckets", F.lit(many(rest)))
    rows = rows.select("uid", "n", "h", F.coalesce("queue", F.lit(len(named))).alias("queue"), F.pmod("h", buckets).alias("bucket"))

    def make():
        def of(batch):
            queue, begins = batch.column("queue").to_numpy(), batch.column("before").to_numpy()
            return {c: batch.column(c) for c in ("uid", "n", "queue", "before")} | {"window": schedule.window(queue, begins.astype(float), window)}

        return of

    queued = before(rows, "queue", "bucket", ["h", "uid"], "n").select("uid", "n", "queue", "before")
    sent = stored(map_rows(queued, "uid long, n long, queue int, before long, window long", make).withColumn("span", F.floor(F.col("window") / SPAN)))
    sums = sent.groupBy("span", "window").agg(F.sum("n").alias("_sum"))
    spans = sums.groupBy("span").agg(F.sum("_sum").alias("_span"))
    over_all = spans.select("span", F.coalesce(F.sum("_span").over(W.orderBy("span").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_from"))
    starts = sums.join(over_all, "span").select("window", (F.col("_from") + F.coalesce(F.sum("_sum").over(W.partitionBy("span").orderBy("window").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).alias("_base"))
    inside = W.partitionBy("window").orderBy("queue", "before").rowsBetween(W.unboundedPreceding, -1)
    return sent.withColumn("at", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "window").select("uid", "n", "window", (F.col("at") + F.col("_base")).alias("at"))


def pack(documents: DataFrame, size: int = SIZE, shares: dict[str | None, float] | None = None, window: int = WINDOW, vocab: str | None = None, closing: int = CLOSING) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, source, ids."""
    tokens = tokenized(documents, vocab, closing)
    plan = placed(tokens, shares, window).select("uid", "window", "at")

    def make():
        def of(batch):
            out = {x: [] for x in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source", "ids")}
            cols = [batch.column(x) for x in ("doc_id", "source", "n", "window", "at", "ids")]
            for row in zip(*cols, strict=True):
                doc_id, source, n, win, at, raw = (x.as_py() for x in row)
                ids, start = np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4").astype("<u4"), 0
                while start < n:
                    offset = (at + start) % size
                    k = min(n - start, size - offset)
                    part = ids[start : start + k].tobytes()
                    for name, v in zip(out, (doc_id, start, k, zlib.crc32(part), n, (at + start) // size, offset, win, source, part), strict=True):
                        out[name].append(v)
                    start += k
            return out

        return of

    fields = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window long, source string, ids binary"
    return map_rows(tokens.join(plan, "uid"), fields, make)
