"""License scans: fuzzy search for short notices (operator 10).

A notice of n letters with at most e edits, cut into e + 1 pieces, keeps at least one piece unchanged (pigeonhole).
One automaton finds all pieces of all notices in a single pass over the text. Around a hit most of the notice's runs of
three letters must be there too: an edit spoils no more than three of them. Where they are, the regex library's
bounded-error matching checks the whole notice and gives its span and number of edits.

Defined results: a null text counts as empty and gives zeros, nulls and empty strings; rows are independent, so repeated
ids and rows each get their own result; other columns of the input are ignored, an empty table gives an empty table.
"""

from __future__ import annotations

import bisect

import ahocorasick
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_rows

#: Exact phrases and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices in normal form (lower case, words parted by one space) and their labels.
NOTICES = (
    ("released under the mit license", "mit"),
    ("licensed under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("creative commons attribution noncommercial", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("creative commons attribution sharealike", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under the gnu general public license version 2", "gpl-2"),
    ("licensed under the gnu lesser general public license", "lgpl"),
    ("subject to the terms of the mozilla public license", "mpl"),
    ("redistribution and use in source and binary forms with or without modification", "bsd"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
)
#: Letters of a notice for each edit allowed.
LETTERS_PER_EDIT = 12
#: Letters of the runs that a candidate must share.
GRAM = 3

_SEPARATORS = bytes(range(0x00, 0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80))
_TABLE = bytes(32 if i in _SEPARATORS else i for i in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words: runs of digits, a-z and characters beyond ASCII, after lower-casing A-Z alone."""
    return (text or "").encode("utf-8", "surrogatepass").lower().translate(_TABLE).split()


def pieces(notice: str, edits: int) -> list[tuple[int, str]]:
    """The notice cut into edits + 1 pieces of near equal length, with where each begins."""
    n = len(notice)
    cuts = [round(i * n / (edits + 1)) for i in range(edits + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def blanks_before(text: str | bytes, places: list[int]) -> list[int]:
    """The number of blanks before each of the ascending places, in one pass over the text."""
    blank, last, n, out = " " if isinstance(text, str) else b" ", 0, 0, []
    for at in places:
        n += text.count(blank, last, at)
        last = at
        out.append(n)
    return out


class Scanner:
    """Finds phrases exactly and notices with bounded edits in whole texts."""

    def __init__(self, phrases=PHRASES, notices=NOTICES, letters_per_edit: int = LETTERS_PER_EDIT):
        self.phrases = [(f" {p} ".encode(), label) for p, label in phrases.items()]
        self.notices, seeds = [], {}
        for i, (notice, label) in enumerate(notices):
            edits = len(notice) // letters_per_edit
            grams = [notice[j : j + GRAM] for j in range(len(notice) - GRAM + 1)]
            self.notices.append((label, len(notice), edits, regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={edits}}}"), grams))
            for at, piece in pieces(notice, edits):
                seeds.setdefault(piece, []).append((i, at))
        self.machine = ahocorasick.Automaton()
        for piece, uses in seeds.items():
            self.machine.add_word(piece, (len(piece), uses))
        self.machine.make_automaton()

    def exact(self, words: list[bytes]) -> list[tuple[int, str]]:
        """(word index, label) of every place of a phrase."""
        joined, starts = b" " + b" ".join(words) + b" ", []
        for phrase, label in self.phrases:
            at = joined.find(phrase)
            while at >= 0:
                starts.append((at, label))
                at = joined.find(phrase, at + 1)
        starts.sort()
        return list(zip(blanks_before(joined, [at for at, _ in starts]), [label for _, label in starts], strict=True))

    def fuzzy(self, words: list[bytes]) -> list[tuple[int, int, str, int, float]]:
        """(first word, last word, label, edits, similarity) of every best match of a notice; of matches that
        overlap, the most similar stays, then the earliest."""
        joined = b" ".join(words).decode("utf-8", "surrogatepass")
        places: dict[int, list[tuple[int, int]]] = {}
        for end, (size, uses) in self.machine.iter(joined):
            for i, at in uses:
                _, n, e, _, _ = self.notices[i]
                a = end + 1 - size - at - e
                span = (max(0, a), min(len(joined), a + n + 2 * e))
                own = places.setdefault(i, [])
                if own and abs(span[0] - own[-1][0]) <= 2 * e:  # another piece of the same place
                    own[-1] = (min(own[-1][0], span[0]), max(own[-1][1], span[1]))
                else:
                    own.append(span)
        found = set()
        for i, open_spans in places.items():
            label, n, e, pattern, grams = self.notices[i]
            while open_spans:
                a, b = open_spans.pop()
                part = joined[a:b]
                if len(part) < n - e or sum(g in part for g in grams) < len(grams) - GRAM * e or not (m := pattern.search(joined, a, b)):
                    continue
                edits = sum(m.fuzzy_counts)
                found.add((-(1 - edits / n), m.start(), m.end(), label, edits))
                open_spans += [(a, m.start()), (m.end(), b)]  # the best match may have others before it
        starts, kept = [], []
        for s, a, b, label, edits in sorted(found):
            at = bisect.bisect_left(starts, a)
            if (at == 0 or kept[at - 1][1] <= a) and (at == len(starts) or starts[at] >= b):
                starts.insert(at, a)
                kept.insert(at, (a, b, label, edits, -s))
        first, last = blanks_before(joined, starts), blanks_before(joined, [x[1] for x in kept])
        return [(u, v, *x[2:]) for u, v, x in zip(first, last, kept, strict=True)]


def scan(documents: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every document with its exact places and fuzzy spans: doc_id, n_words, exact (word, label), spans (first_word,
    last_word, label, edits, similarity)."""

    def make():
        scanner = Scanner()

        def of(batch):
            ids, out = batch.column("id").to_pylist(), {"n_words": [], "exact": [], "spans": []}
            for t in batch.column("text"):
                words = words_of(t.as_py())
                out["n_words"].append(len(words))
                out["exact"].append([{"word": w, "label": x} for w, x in scanner.exact(words)])
                out["spans"].append([dict(zip(("first_word", "last_word", "label", "edits", "similarity"), x, strict=True)) for x in scanner.fuzzy(words)])
            return {"doc_id": ids, **out}

        return of

    fields = "doc_id long, n_words long, exact array<struct<word:long,label:string>>, spans array<struct<first_word:long,last_word:long,label:string,edits:int,similarity:double>>"
    return map_rows(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fields, make)


def labelled(documents: DataFrame, **cols) -> DataFrame:
    """scan() as one row of labels for each document: n_base counts all exact places, labels joins the exact labels and
    those of fuzzy spans, score is 1 with an exact place, else the best similarity, 0 without any."""
    found = scan(documents, **cols)
    joined = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    return found.select(
        "doc_id",
        "n_words",
        F.size("exact").cast("long").alias("n_base"),
        F.array_min("exact.word").alias("first_word"),
        F.array_max("exact.word").alias("last_word"),
        joined(F.col("exact.label")).alias("base_labels"),
        joined(F.concat("exact.label", "spans.label")).alias("labels"),
        F.when(F.size("exact") > 0, 1.0).otherwise(F.coalesce(F.array_max("spans.similarity"), F.lit(0.0))).alias("score"),
        "spans",
    )
