"""Spelling variants, the divergence audit and BPE: brute force, tokenizers, and the defined results of odd rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import bpe, divergence, spelling

DOC = "doc_id long, text string, lang string, source string"
CLASHES = ("id", "n", "word", "form", "root", "key", "term", "c", "df", "total", "vec", "p", "q", "g", "s", "t", "item", "value", "rank", "part", "ids", "_r", "_spread", "size", "best")


@pytest.fixture(scope="module")
def odd(spark):
    long = "Wörterbuch wörterbuch woerterbuch " * 20_000
    rows = [
        (1, "Analysis of the analysis", "en", "a"), (2, "analysis <|endoftext|> ANALYSIS", "en", "a"), (2, "analysis <|endoftext|> ANALYSIS", "en", "a"), (3, None, None, None), (4, "", "", "b"),
        (5, long, "de", "a"), (None, "anälysis ÄNALYSIS", "en", None), (6, "x" * 50_000, "en", "b"), (7, "日本語 \U0001f600 été İ \x00 \x85", "ja", "c"), (8, "×÷×÷×÷× ÷×÷×÷×÷", "en", "c"),
    ]
    return spark.createDataFrame(rows, DOC).withColumns({c: F.lit("odd") for c in CLASHES})


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants_by_hand(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}
    forms, out = {}, {}
    for w in n:
        near = [x for x in n if x != w and is_near(w, x)]
        best = min(near, key=lambda x: (-n[x], x), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = [n[w], len(near), n[forms[w]] if forms[w] else None]
    for w in n:
        root = w
        while forms[root]:
            root = forms[root]
        out[w] = (forms[w], root, *out[w])
    return out


def variants(docs, **options):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in spelling.variants(docs, **options).collect()}


def test_spelling_of_chains_and_hot_groups(spark, odd):
    rnd, rows = random.Random(3), []
    for i in range(60):
        word = "".join(rnd.choice("abcdeé") for _ in range(rnd.choice([7, 8, 9])))
        for k in (400, 30, 3, 2):  # each the slip of the one before it
            rows += [(i, " ".join([word.upper() if word.isascii() else word] * k))]
            at = rnd.randrange(len(word))
            word = rnd.choice([word[:at] + "x" + word[at:], word[:at] + "y" + word[at + 1 :], word[:at] + word[at + 1 :] + "zz"])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = variants_by_hand(rows)
    assert len({r[1] for r in want.values()}) < len(want) and any(r[0] and r[0] != r[1] for r in want.values())
    assert variants(docs) == want
    assert variants(docs, group=12) == want  # groups cut by more bands, then by tiles
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    got = variants(odd)
    assert got == variants_by_hand(rows) and got["analysis"][2] >= 4
    assert spelling.variants(odd.limit(0)).count() == 0


def test_near_pairs_belong_to_one_band():
    left = list(range(len(spelling.LETTERS)))
    for path in ([0], [2], [1, 0], [2, 2, 1]):
        earlier, rest = spelling.cut(path)
        assert set(rest) < set(left) and len(earlier) == sum(path)
    a, b = spelling.halves([0, 44, 45, 89])
    assert (a | b << 45) == 1 | 1 << 44 | 1 << 45 | 1 << 89


def audit_by_hand(rows, least=10, top=10):
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    docs = [(a or "", b or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", lower(t or ""))) for t, a, b in rows]
    df, count = defaultdict(Counter), defaultdict(Counter)
    for a, b, terms in docs:
        df[a].update(set(terms))
        count[a, b].update(terms)
    out = []
    for lang in {a for a, _ in count}:
        kept = {t for t, k in df[lang].items() if k >= least}
        groups = {b: {t: c for t, c in own.items() if t in kept} for (a, b), own in count.items() if a == lang}
        whole = Counter()
        for own in groups.values():
            whole.update(own)
        share = lambda c, own: 1 + 10**9 * (c + 2) // (sum(own.values()) + 2 * len(kept))  # noqa: E731, B023
        f = lambda p, q: (p - q) ** 2 // (p + q)
        for b, own in groups.items():
            p = {t: share(own.get(t, 0), own) for t in kept}
            pairs = [(o, sum(f(p[t], share(x.get(t, 0), x)) for t in kept)) for o, x in groups.items() if o != b]
            above = [(t, f(p[t], share(whole[t], whole))) for t in own if p[t] > share(whole[t], whole)]
            for part, items, most in (("pair", pairs, None), ("term", above, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, b, part, item, v, i + 1) for i, (item, v) in enumerate(items)]
    return out


def test_divergence(spark, odd):
    rnd = random.Random(1)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}é" for i in range(80)] + ["日本", "Ñu"]
    rows = []
    for i in range(400):  # a third of all rows in one source; words of equal columns; a group without kept terms
        source = "hot" if i % 3 == 0 else f"s{i % 5}"
        text = " ".join(rnd.choices(words, weights=[1 / (k + 1) for k in range(len(words))], k=30)) + " same twin same twin"
        rows.append((i, text if i % 7 else text.upper(), "en" if i % 4 else "de", source))
    rows += [(1000, "only here", "en", "rare"), (1001, None, "fr", "a"), (1002, "1 2 3", "fr", None), (1003, "rare", "it", "alone")]
    docs = spark.createDataFrame(rows, DOC)
    for least in (10, 60):
        got = [tuple(r) for r in divergence.audit(docs, least).select("lang", "source", "part", "item", "value", "rank").collect()]
        assert sorted(got) == sorted(audit_by_hand([r[1:] for r in rows], least))
    rows = [tuple(r) for r in odd.select("text", "lang", "source").collect()]
    for least in (1, 2):
        got = [tuple(r) for r in divergence.audit(odd, least).collect()]
        assert sorted(got) == sorted(audit_by_hand(rows, least))
    assert divergence.audit(odd.limit(0)).count() == 0


def test_terms_of_long_texts(monkeypatch):
    text = "Älpha beta,γάμμα 1 " * 500
    whole = [t for part in divergence.terms_of(text) for t in part]
    monkeypatch.setattr(divergence, "SLICE", 64)
    assert [t for part in divergence.terms_of(text) for t in part] == whole and whole[:3] == ["Älpha", "beta", "γάμμα"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.vocabulary("word_bpe_49k.json"))


def test_bpe_equals_tokenizers(tokenizer, monkeypatch):
    rnd = random.Random(1)
    texts = ["", " ", "Hello world's it'll 'tis 'S 123 abc!!! <|endoftext|> hi<|startoftext|>", "É é ŒUVRE ½ ² ﬁ İstanbul ΣΑΣ 日本 á \x1c \x85 x", "a" * 3000, "ab" * 500, "<|endoftext|", "<|endoftext|>"]
    texts += ["".join(map(chr, range(0x20, 0x3000))), " ".join(map(chr, range(0x20, 0x3000))), " ".join(bpe._PLAIN), "".join(bpe._PLAIN)]
    texts += ["".join(rnd.choice("abcdeéêABC '’12.,\n\tsrtvelm<|>日\U0001f600́") for _ in range(rnd.randrange(80))) for _ in range(200)]
    want = [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
    assert bpe.ids_of(texts) == want
    assert [bpe.decode(x) for x in want] == [tokenizer.decode(x, skip_special_tokens=False) for x in want]
    # small chunks and a small memory of words change nothing
    monkeypatch.setattr(bpe, "CHUNK", 16)
    monkeypatch.setattr(bpe, "HELD", 8)
    monkeypatch.setattr(bpe, "LONGEST", 4)
    made = bpe.digests(bpe.Codec(bpe.vocabulary("word_bpe_49k.json")), texts)
    assert [x.n for x in made] == list(map(len, want))
    assert [x.ids.hexdigest() for x in made] == [hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest() for x in want]
    assert [x.decoded.hexdigest() for x in made] == [hashlib.sha256(tokenizer.decode(x, skip_special_tokens=False).encode()).hexdigest() for x in want]


def test_pair_index_takes_a_lower_rank_first():
    vocab = {c: i for i, c in enumerate([*map(chr, bpe.byte_letters().values())])}
    vocab |= {c + "$": len(vocab) + i for i, c in enumerate(list(vocab))}
    for made in ("bc", "abc", "abca"):
        vocab[made] = len(vocab)
    # abc + a has a lower rank than a + bc, which makes abc: in abcabc it takes the second a before a + bc does
    merges = bpe.Merges({"vocab": vocab, "merges": [["b", "c"], ["abc", "a"], ["a", "bc"]], "end_of_word_suffix": "$"})
    flat, ends = merges.encode(["abcabcx", "bcx"])
    names = [merges.tokens[i] for i in flat]
    assert names[: ends[0]] == ["abca", "bc", "x$"] and names[ends[0] :] == ["bc", "x$"]


def test_bpe_of_odd_rows(odd, tokenizer):
    rows = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encoded(odd).collect()}
    want = set()
    for r in odd.collect():
        ids = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        want.add((r.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tokenizer.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert rows == want and bpe.encoded(odd).count() == odd.count()
    assert bpe.encoded(odd.limit(0)).count() == 0
