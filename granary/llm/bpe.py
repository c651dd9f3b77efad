"""BPE encoding and decoding with a pair occurrence index (operator 13).

Texts are normalised and cut into words as the tokenizer's file says; a word's ids depend on the word alone. The distinct
words of a chunk of a partition that are not known yet are laid one after the other as symbols, one for each byte, and
each pair of neighbours that a merge exists for is mapped to all its positions there. The active ranks, those of pairs in the index, are taken in
ascending order from a heap; a rank's merge is applied at all its positions, and the lists of the pairs to the left and right
of each are updated. Where a merge makes a pair of a lower rank, that one comes first, as it does in the tokenizer.

A task remembers at most twice HELD words and looks at CHUNK characters at once, also of one long text, whose digests are
carried on from part to part. Texts of characters in _PLAIN, about which this module and the tokenizer agree, are cut by a
pattern; others by the tokenizer's own normaliser and splitter, whole.

Defined results: null text counts as empty: no ids, and an empty decoded text; the strings of special tokens in a text are
these tokens, as in tokenizers; rows that repeat an id have a result each; a null id stays null; an empty table gives an empty
table; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_rows
from granary.llm.packing import byte_letters, parts_of, vocabulary

#: Words that a task remembers, twice over, characters of the longest of them, and characters looked at at once.
HELD, LONGEST, CHUNK = 400_000, 64, 1 << 21
#: Characters of texts that the pattern cuts: no marks that combine, none whose small form is more than one.
_PLAIN = [chr(i) for i in (*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x250), *range(0x2010, 0x2028))]


def _class(of: str) -> str:
    """The plain characters of a kind, small ones for letters, for a pattern."""
    return "".join(re.escape(c) for c in sorted({c.lower() for c in _PLAIN if (c.isspace() if of == "Z" else unicodedata.category(c)[0] == of)}))


class Merges:
    """The merges of a tokenizers file, and the pair occurrence index over words that applies them."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.tokens = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.tokens[i] = t
        letters = {b: chr(c) for b, c in byte_letters().items()}
        end = model["end_of_word_suffix"] or ""
        self.first = np.array([vocab[letters[b]] for b in range(256)])
        self.last = np.array([vocab[letters[b] + end] for b in range(256)])
        self.width = 1 << len(self.tokens).bit_length()
        pairs = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        self.pair_of = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        keys = [a * self.width + b for a, b, _ in self.pair_of]
        self.rank_of = {k: rank for rank, k in enumerate(keys)}
        self.by_key = np.argsort(keys)
        self.keys = np.append(np.array(keys)[self.by_key], 1 << 62)

    def index(self, symbols: np.ndarray, lasts: np.ndarray) -> dict[int, list[int]]:
        """The positions of each pair of neighbours, by the rank of its merge; `lasts` have no neighbour to the right."""
        keys = symbols[:-1] * self.width + symbols[1:]
        keys[lasts[:-1]] = -1
        found = np.searchsorted(self.keys, keys)
        at = np.flatnonzero(self.keys[found] == keys)
        ranks = self.by_key[found[at]]
        order = np.argsort(ranks, kind="stable")
        ranks, at = ranks[order], at[order].tolist()
        cuts = np.flatnonzero(np.diff(ranks, prepend=-1))
        bounds = [*cuts.tolist(), len(at)]
        return {r: at[a:b] for r, a, b in zip(ranks[cuts].tolist(), bounds[:-1], bounds[1:], strict=True)}

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and where each word's end."""
        raw = [w.encode() for w in words]
        ends = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        made = self.first[flat]
        made[ends - 1] = self.last[flat[ends - 1]]
        index = self.index(made, ends - 1)
        # neighbours of each position, 0 where a word ends (no symbol's next is at 0), -1 where one begins
        after, before = np.arange(1, len(flat) + 1), np.arange(-1, len(flat))
        after[ends - 1], before[ends[:-1]] = 0, -1
        symbols = self.merged(made.tolist(), after.tolist(), before.tolist(), index)
        stays = symbols >= 0
        return symbols[stays], np.cumsum(stays)[ends - 1]

    def merged(self, symbols: list[int], after: list[int], before: list[int], index: dict[int, list[int]]) -> np.ndarray:
        """The symbols after all merges, -1 where one became part of the one before it."""
        rank_of, width, pair_of, active, listed, push = self.rank_of.get, self.width, self.pair_of, list(index), index.get, heapq.heappush
        heapq.heapify(active)
        while active:
            rank = heapq.heappop(active)
            a, b, made = pair_of[rank]
            base, places = made * width, index.pop(rank)
            places.sort()
            for at, i in enumerate(places):
                j = after[i]
                if not j or symbols[j] != b or symbols[i] != a:
                    continue  # a merge of a lower rank took one of the two
                symbols[i], symbols[j], lower = made, -1, rank
                k = after[i] = after[j]
                if k:
                    before[k] = i
                    if (r := rank_of(base + symbols[k])) is not None:
                        if (there := listed(r)) is not None:
                            there.append(i)
                        else:
                            index[r] = [i]
                            push(active, r)
                        if r < lower:
                            lower = r
                k = before[i]
                if k >= 0 and (r := rank_of(symbols[k] * width + made)) is not None:
                    if (there := listed(r)) is not None:
                        there.append(k)
                    else:
                        index[r] = [k]
                        push(active, r)
                    if r < lower:
                        lower = r
                if lower < rank:  # that pair comes first; the places left wait
                    if rank not in index:
                        push(active, rank)
                    index.setdefault(rank, []).extend(places[at + 1 :])
                    break
        return np.array(symbols)


class Codec:
    """Words of a text, and the ids and decoded text of each word, remembered."""

    def __init__(self, vocab: str):
        from tokenizers import Tokenizer

        with open(vocab, encoding="utf-8") as f:
            told = json.load(f)
        self.tokenizer = Tokenizer.from_file(vocab)
        self.merges = Merges(told["model"])
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        self.cuts = re.compile(f"({'|'.join(map(re.escape, self.special))})") if self.special else None
        letter, digit, space = _class("L"), _class("N"), _class("Z")
        self.words = re.compile(f"'(?:[stmd]|re|ve|ll)|[{letter}]+|[{digit}]|[^{space}{letter}{digit}]+").findall
        self.odd = re.compile(f"[^{''.join(map(re.escape, _PLAIN))}]").search
        self.names = self.merges.tokens + [""] * (max(self.special.values(), default=0) + 1 - len(self.merges.tokens))
        for name, i in self.special.items():
            self.names[i] = name
        self.ids, self.older, self.long = {}, {}, []

    def pieces(self, text: str) -> list[str]:
        """Words of a text that the pattern can't cut, by the tokenizer's own parts."""
        return [x for x, _ in self.tokenizer.pre_tokenizer[0].pre_tokenize_str(self.tokenizer.normalizer.normalize_str(text))]

    def parts(self, text: str) -> Iterator[tuple[int, list[str] | int]]:
        """Lists of words with their characters, and ids of special tokens between them."""
        for part in self.cuts.split(text) if self.cuts and "<|" in text else (text,):
            if part in self.special:
                yield 1, self.special[part]
            elif self.odd(part):
                yield len(part), self.pieces(part)
            else:
                for x in parts_of(part, CHUNK):
                    yield len(x), self.words(x.lower())

    def known(self, lists: list[list[str]]) -> None:
        """Sees to it that the words of all lists are held."""
        need = set().union(*lists)
        new = need.difference(self.ids)
        if len(self.ids) + len(new) > HELD:
            self.older, self.ids, new = self.ids, {}, need
        older = self.older
        was = new.intersection(older)
        self.ids.update(zip(was, map(older.__getitem__, was), strict=True))
        ask = list(new - was)
        if not ask:
            return
        flat, ends = self.merges.encode(ask)
        raw, ends = flat.astype("<u4").tobytes(), (4 * ends).tolist()
        self.ids.update(zip(ask, [raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)], strict=True))
        self.long += [w for w in ask if len(w) > LONGEST]

    def forget_long(self) -> None:
        """Drops words too long to be remembered, so that memory is bounded in bytes as well."""
        for w in self.long:
            self.ids.pop(w, None)
        self.long.clear()

    def decode(self, ids: bytes) -> str:
        """The tokens with a blank between, as the file names no decoder."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class Digest:
    """Number of ids of one text and the two digests, part by part."""

    def __init__(self):
        self.n, self.ids, self.decoded = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: bytes, decoded: str) -> None:
        if ids:
            self.decoded.update(((" " if self.n else "") + decoded).encode())
            self.ids.update(ids)
            self.n += len(ids) // 4


@functools.cache
def codec(vocab: str) -> Codec:
    return Codec(vocab)


def digests(coder: Codec, texts: list[str | None]) -> list[Digest]:
    """The digests of each text; words of texts are made known CHUNK characters at a time."""
    out, waiting, size = [Digest() for _ in texts], [], 0

    def flush() -> None:
        coder.known([words for _, words in waiting if not isinstance(words, int)])
        for at, words in waiting:
            if isinstance(words, int):
                ids = np.array([words], "<u4").tobytes()
            else:
                ids = b"".join(map(coder.ids.__getitem__, words))
            out[at].add(ids, coder.decode(ids))
        coder.forget_long()
        waiting.clear()

    for i, text in enumerate(texts):
        for n, words in coder.parts(text or ""):
            waiting.append((i, words))
            size += n
            if size >= CHUNK:
                flush()
                size = 0
    flush()
    return out


def encoded(documents: DataFrame, vocab: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each document: its ids as little-endian unsigned 32-bit numbers, and the
    text that they decode to."""
    vocab = vocab or vocabulary("word_bpe_49k.json")

    def make():
        coder = codec(vocab)

        def of(batch):
            made = digests(coder, batch.column("text").to_pylist())
            return {"doc_id": batch.column("doc_id"), "n_tokens": [x.n for x in made], "ids_sha256": [x.ids.hexdigest() for x in made], "decoded_sha256": [x.decoded.hexdigest() for x in made]}

        return of

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return map_rows(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def ids_of(texts: list[str], vocab: str | None = None) -> list[list[int]]:
    """The ids of some texts, for callers in the same process."""
    coder, out = codec(vocab or vocabulary("word_bpe_49k.json")), []
    for text in texts:
        ids: list[int] = []
        for _, words in coder.parts(text):
            if isinstance(words, int):
                ids.append(words)
            else:
                coder.known([words])
                for w in words:
                    ids.extend(np.frombuffer(coder.ids[w], "<u4").tolist())
        out.append(ids)
    return out


def decode(ids: list[int], vocab: str | None = None) -> str:
    """The text of ids: their tokens with a blank between, as the file names no decoder; unknown ids are left out."""
    coder = codec(vocab or vocabulary("word_bpe_49k.json"))
    return coder.decode(np.array([i for i in ids if 0 <= i < len(coder.names)], "<u4").tobytes())
