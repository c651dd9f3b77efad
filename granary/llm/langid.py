"""Language identification by rank-order profiles (operator 4).

Training counts the n-grams of one to three letters of each language over all its documents and keeps the most frequent
ones in order. A document's own ranking is compared to each by the out-of-place distance: the sum over the document's
n-grams of how far their ranks differ, the profile's length where one is missing.

A word is a run of letters in lower case; n-grams include the word's borders (as in "_t" and "th_"), never reach over
them. Ties in frequency go to the n-gram that comes first by its code points.

Defined results: null text, empty text and text without a letter give `und` with score 0; rows without a language are
not learned from; without anything to learn from all rows give `und`; of languages at the same distance the first by
name wins; rows that repeat are each counted and each predicted; other columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from granary.llm.common import arrow_schema, map_rows, to_arrow

#: N-grams in a profile.
PROFILE = 400
#: Languages that the profiles sent to every task can hold (400 n-grams of 12 bytes each: 50 MB).
MOST_LANGUAGES = 10_000
UNKNOWN = "und"
_BITS = 21


@functools.cache
def letters() -> np.ndarray:
    """For each code point its lower-case letter, or 0 if it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def codes(text: str) -> np.ndarray:
    """Letters of the text, a single 1 at each border of a word."""
    raw = letters()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
    raw = np.concatenate(([0], raw, [0]))
    keep = (raw != 0) | np.concatenate(([True], raw[:-1] != 0))
    raw = raw[keep]
    raw[raw == 0] = 1
    return raw


def ngrams(c: np.ndarray) -> np.ndarray:
    """Sorted keys of all n-grams of one to three letters or borders; a border stands only at an n-gram's ends."""
    a, b = c[:-1], c[1:]
    two = (a << _BITS | b)[(a != 1) | (b != 1)]
    three = (c[:-2] << 2 * _BITS | c[1:-1] << _BITS | c[2:])[c[1:-1] != 1]
    keys = np.concatenate((c[c != 1], two, three))
    keys.sort()
    return keys


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, keys
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[at], np.diff(np.append(at, len(keys)))


def slices(text: str, size: int = 1 << 20):
    """The text in slices of bounded length, cut at a blank where there is one."""
    a = 0
    while len(text) - a > size:
        b = text.rfind(" ", a + 1, a + size) + 1 or a + size
        yield text[a:b]
        a = b
    yield text[a:] if a else text


def all_ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the text's n-grams and their numbers."""
    held = [counted(ngrams(codes(part))) for part in slices(text)]
    if len(held) == 1:
        return held[0]
    keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
    return keys, np.bincount(at, np.concatenate([n for _, n in held]), len(keys)).astype(np.int64)


def ranking(text: str, size: int) -> np.ndarray:
    """The text's most frequent n-grams, most frequent first."""
    keys, n = all_ngrams(text)
    return keys[np.argsort(-n, kind="stable")[:size]]


class Profiles:
    """Ranks by language, looked up for a whole ranking at once."""

    def __init__(self, by_lang: dict[str, list[int]], size: int):
        self.langs, self.size = sorted(by_lang), size
        self.keys = np.unique(np.array([k for v in by_lang.values() for k in v], np.int64))
        self.ranks = np.full((len(self.keys) + 1, len(self.langs)), -1, np.int32)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.keys, by_lang[lang]), j] = np.arange(len(by_lang[lang]))

    def distances(self, own: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, own)
        at[at < len(self.keys)] = np.where(self.keys[at[at < len(self.keys)]] == own[at < len(self.keys)], at[at < len(self.keys)], len(self.keys))
        ranks = self.ranks[at]
        off = np.abs(ranks - np.arange(len(own), dtype=np.int32)[:, None])
        return np.where(ranks < 0, self.size, np.minimum(off, self.size)).sum(0, dtype=np.int64)

    def best(self, text: str | None) -> tuple[str, float]:
        own = ranking(text or "", self.size)
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        d = self.distances(own)
        j = int(d.argmin())
        return self.langs[j], 1.0 - float(d[j]) / (self.size * len(own))


def train(documents: DataFrame, size: int = PROFILE, text_col: str = "text", lang_col: str = "lang") -> dict[str, list[int]]:
    """Profiles of the rows' languages. Tasks count by batch and language, partial sums meet by n-gram, and only the
    `size` first n-grams of each language come to the driver."""
    schema = arrow_schema("lang string, gram long, n long")

    def count(batches):
        out = to_arrow(schema)
        for batch in batches:
            by = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
                by.setdefault(lang, []).append(text.as_py())
            for lang, texts in by.items():
                parts, held = [], 0
                for t in [x for text in texts for x in slices(text)] + [None]:
                    if t is not None:
                        parts.append(ngrams(codes(t)))
                        held += len(parts[-1])
                    if parts and (t is None or held > 4_000_000):
                        all_keys = np.concatenate(parts)
                        all_keys.sort()
                        keys, n = counted(all_keys)
                        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], schema=out)
                        parts, held = [], 0

    rows = documents.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    grams = rows.mapInArrow(count, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = W.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = grams.withColumn("r", F.row_number().over(order)).where(F.col("r") <= size)
    found: dict[str, list[tuple[int, int]]] = {}
    for lang, gram, r in top.select("lang", "gram", "r").toLocalIterator():
        found.setdefault(lang, []).append((r, gram))
        if len(found) > MOST_LANGUAGES:
            raise ValueError(f"more than {MOST_LANGUAGES} languages: the profiles would not fit the tasks")
    return {lang: [g for _, g in sorted(v)] for lang, v in found.items()}


def predict(documents: DataFrame, profiles: dict[str, list[int]], size: int = PROFILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred and score (1 at no distance, 0 at the largest) of every row."""

    def make():
        known = Profiles(profiles, size)

        def of(batch):
            best = [known.best(x.as_py()) for x in batch.column("text")]
            return {"doc_id": batch.column("id").to_pylist(), "lang_pred": [x[0] for x in best], "score": [x[1] for x in best]}

        return of

    return map_rows(documents.select(F.col(id_col).cast(T.LongType()).alias("id"), F.col(text_col).alias("text")), "doc_id long, lang_pred string, score double", make)


def fold(id_col: str | Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def identify(documents: DataFrame, folds: int = 4, held_out: int = 2, size: int = PROFILE) -> DataFrame:
    """Learns from all folds but one and predicts every row: doc_id, held_out, lang_pred, score. Rows without an id are
    in no fold: not learned from, held_out false."""
    rows = documents.select("doc_id", "text", "lang")
    profiles = train(rows.where(fold("doc_id", folds) != held_out), size)
    out = predict(rows, profiles, size)
    return out.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
