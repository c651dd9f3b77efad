"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names: each operator's defined results."""

import time

import pytest
from pyspark.sql import functions as F

from granary.llm import ann, html_text, langid, licenses, line_dedup, mips, mixing, ngram_join, packing, quality

LONG = "alpha beta gamma delta " * 20000
TEXT = "the quick brown fox jumps over the lazy dog again and again near the river"
ROWS = [
    (1, TEXT, "en", "src1"), (2, TEXT, "en", "src1"), (2, TEXT, "en", "src1"), (3, None, "en", "src1"), (4, "", None, None),
    (5, LONG, "en", "src8"), (None, TEXT, "de", "src2"), (6, "   \n\n ", "fr", None), (7, "été \U0001f600 " * 30, None, "web"), (8, "x", "fr", "src1"),
]
CLASHES = ("id", "uid", "n", "ids", "h", "bucket", "window", "score", "_row", "_text", "_id", "_k", "_at", "_gone", "_first", "_epoch", "key", "tree", "to", "x", "size", "rep", "vec", "quality", "_lines", "_domain")


def clashes():
    return {c: F.lit("odd") for c in CLASHES}


DOC = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOC).withColumn("n_chars", F.length("text").cast("long")).withColumns(clashes())


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 1, None), (2, None, 0), (5, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")


def test_quality(docs, none, labels):
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert not [r for r in rows if r.doc_id is None and r.held_out]
    assert quality.classify(none, labels).count() == 0
    assert {r.score for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= len(ROWS)
    assert quality.keep_good(none, labels).count() == 0


def test_language(docs, none):
    rows = langid.identify(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert all(by[k].lang_pred == "und" and by[k].score == 0 for k in (3, 4, 6))
    assert by[1].lang_pred in ("en", "de", "fr")
    assert langid.identify(none).count() == 0


def test_packing(docs, none):
    rows = packing.pack(docs).collect()
    assert packing.pack(none).count() == 0
    check_pieces(rows, 2048)
    assert {r.doc_id for r in rows} == {r[0] for r in ROWS}
    assert sorted(r.doc_tokens for r in rows if r.doc_id == 3) == [1]
    check_pieces(packing.pack(docs, shares={"src1": 0.9}, window=512).collect(), 2048)


def check_pieces(rows, size):
    held = {}
    for r in rows:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at and n > 0
            at += n
        assert at <= size
    full = sum(sum(n for _, n in p) == size for p in held.values())
    assert full >= len(held) - 1


def test_line_dedup(docs, none, spark):
    rows = line_dedup.dedup(docs).collect()
    assert len(rows) == len(ROWS) and line_dedup.dedup(none).count() == 0
    assert line_dedup.dedup(docs).columns == [*docs.columns, "_removed"]
    assert {r.doc_id for r in rows if r.text is None} == {3}
    long_line = " ".join(f"w{i}" for i in range(60))
    two = spark.createDataFrame([(9, f"a\n{long_line}\nb"), (4, f"c\n{long_line}"), (None, "z"), (11, "one\ntwo")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r._removed) for r in line_dedup.dedup(two, long_words=40).collect()}
    assert got == {9: ("a\nb", 1), 4: (f"c\n{long_line}", 0), None: ("z", 0), 11: ("one\ntwo", 0)}


def test_line_dedup_of_runs(spark, monkeypatch):
    texts, want = {}, {}
    for n in range(2, 9):  # passages of 2 to 8 short lines between other lines
        for j in range(6):
            passage = [f"passage {n} {j} line {i} of some plain words here" + " and more of them" * (12 // n) for i in range(n)]
            if n > 4:
                passage[2] = ""
            for k in (0, 1000):
                i = n * 10 + j + k
                around = [f"own {i} {m}" for m in range(6)]
                texts[i] = "\n".join([*around[:3], *passage, *around[3:]])
                want[i] = texts[i] if k == 0 else "\n".join(around)
    texts |= {5000: "x one\nx one\nx one", 5001: "short heading\n\nown words a", 5002: "short heading\n\nown words b"}
    # lines that overlap the first place stay; of one short line in common nothing goes
    want |= {5000: texts[5000], 5001: texts[5001], 5002: texts[5002]}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    odd = [i for i in want if got[i] != want[i]]
    assert not odd, [(got[i], want[i]) for i in odd[:2]]
    # different texts under one hash are told apart by their bytes
    plain = F.xxhash64
    monkeypatch.setattr(F, "xxhash64", lambda *cols: plain(*cols) if isinstance(cols[0], str) else F.pmod(F.crc32(cols[0].cast("binary")), F.lit(3)))
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert not [i for i in want if got[i] != want[i]]


def test_line_dedup_of_single_lines(spark):
    long_line = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"a\n{long_line}\nb"), (2, f"c\n{long_line}\nd"), (3, long_line)], "doc_id long, text string")
    assert {r.doc_id: r._removed for r in line_dedup.dedup(df, long_words=40).collect()} == {1: 0, 2: 1, 3: 1}
    assert {r.doc_id: r._removed for r in line_dedup.dedup(df).collect()} == {1: 0, 2: 0, 3: 0}
    # a passage that a third of all rows share, and one text in many rows
    rows = [(i, f"own {i}\n{long_line}\nshared end" if i % 3 == 0 else "x y\nz" if i % 3 == 1 else f"other {i}") for i in range(3000)]
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string"), passage_words=2).collect()}
    assert got == {i: t if i < 3 or i % 3 == 2 else f"own {i}" if i % 3 == 0 else "" for i, t in rows}


def test_line_dedup_by_chunks(spark):
    lines = [f"short {i}" for i in range(30)]
    rows = [(1, "\n".join(["own a", *lines, "own b"])), (2, "\n".join(["own c", *lines, "own d"])), (3, "own e\nshort 3\nshort 4\nown f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    by = lambda spacing, words=None: {r.doc_id: r.text for r in line_dedup.dedup(df, spacing, words).collect()}
    # the chunks find the run, which is followed to both its ends; a lone pair of short lines stays
    assert by(4) == {1: rows[0][1], 2: "own c\nown d", 3: rows[2][1]}
    # one chunk for a whole text is found nowhere else, so that only words can make a passage of the run
    assert by(1 << 30) == dict(rows) and by(1 << 30, 50)[2] == "own c\nown d" and by(1 << 30, 4)[3] == "own e\nown f"


def test_line_dedup_of_many_lines(spark):
    text = "\n".join(f"line number {i} here" for i in range(60_000))
    df = spark.createDataFrame([(1, text), (2, f"own first\n{text}\nown last")], "doc_id long, text string")
    began = time.time()
    assert {r.doc_id: r.text for r in line_dedup.dedup(df).collect()} == {1: text, 2: "own first\nown last"}
    assert time.time() - began < 60  # some seconds alone; hours if it grew with the square


def test_mixing(docs, none):
    mixed = mixing.mix(docs)
    rows = mixed.collect()
    assert mixed.columns == [*[c for c in docs.columns if c not in ("_epoch", "_domain", "_tokens")], "_epoch", "_domain", "_tokens"]
    assert rows and all(r._epoch in (1, 2) for r in rows)
    assert mixing.mix(none).count() == 0


def test_ngram_join(docs, none):
    got = {r.doc_id: r for r in ngram_join.jaccard_classes(docs).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert got[1].class_id == got[2].class_id == 1 and got[1].n_links == 1
    assert all(got[k].class_id == k and got[k].n_links == 0 for k in (3, 4, 5, 6, 7, 8))
    assert ngram_join.jaccard_classes(none).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted({r.doc_id for r in kept.collect()}, key=str) == [1, 3, 4, 5, 6, 7, 8, None]


def test_licenses(docs, none):
    rows = {r.doc_id: r for r in licenses.labelled(docs).collect()}
    assert rows[3].n_words == rows[4].n_words == 0 and rows[3].first_word is None and rows[3].labels == ""
    assert rows[5].n_words == 80000
    assert licenses.labelled(none).count() == 0


def test_html(spark):
    rows = [(1, "u", None), (1, "u", ""), (2, None, "<p>" + "word " * 50000), (None, "u", "<nav><a href=x>Home</a></nav><article><p>Caf&eacute; &amp; more\n\n words</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns(clashes())
    got = html_text.extract(pages).collect()
    assert sorted((str(r.page_id), r.n_chars) for r in got) == [("1", 0), ("1", 0), ("2", 249999), ("None", 17)]
    assert [r.text for r in got if r.page_id is None] == ["Café & more words"]
    assert html_text.extract(pages.limit(0)).count() == 0


VECTORS = [
    (0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [1.0, 2.0]), (1, [9.0, 9.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [1.0, None]),
    (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [3.0]), (9, [-1.0, -2.0]), (20, [0.5, 0.5]),
]


def test_nearest(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns(clashes())
    rows = ann.search(df, F.col("id") % 100 == 0, probe=1.0).collect()
    got = {q: [r.vec_id for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (0, 100)}
    assert got == {0: [1, 100, 20, 8, 9], 100: [0, 1, 20, 8, 9]}
    assert ann.search(df.limit(0), F.col("id") % 100 == 0).count() == 0
    assert ann.search(df.where("vec_id = 0"), F.col("id") % 100 == 0).count() == 0


def test_products(spark):
    df = spark.createDataFrame(VECTORS, "vec_id long, embedding array<float>").withColumns(clashes())
    rows = mips.search(df, F.col("id") % 20 == 0).collect()
    got = {q: [(r.vec_id, r.score) for r in sorted(rows, key=lambda r: r.rank) if r.query_id == q] for q in (0, 20, 100)}
    assert got[0] == [(1, 20480), (100, 20480), (8, 12288), (20, 6144), (3, 0), (4, 0), (9, -20480)]
    assert got[20][0] == (0, 6144)
    assert mips.search(df.limit(0), F.col("id") % 20 == 0).count() == 0
    big = spark.createDataFrame([(0, [3e30, 1.0]), (1, [2.0, 5.0]), (2, [3e30, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(mips.search(big, F.col("id") == 0).collect(), key=lambda r: r.rank)
    assert [(r.vec_id, r.score) for r in got] == [(1, 2**63 - 1), (2, 2**63 - 1)]  # beyond 64 bits they stop there


def test_pipeline_stages(docs, none, labels, spark, tmp_path):
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for table in (docs, none):
        before = table
        for name, stage in corpus_pipeline.STAGES:
            after = stage(spark, before, str(tmp_path)).cache()
            if name == "packing":
                check_pieces(after.collect(), 2048)
                assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect()}
            else:
                assert after.columns == columns and after.count() <= 2 * before.count()
                assert not after.select("doc_id").subtract(table.select("doc_id")).count()
            before = after
    got = corpus_pipeline.first_of_class(spark, docs, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.text == TEXT) for r in got) == [("1", True), ("3", False), ("4", False), ("5", False), ("6", False), ("7", False), ("8", False), ("None", True)]
    kept = corpus_pipeline.without_repeats(spark, spark.createDataFrame([(1, "a b\nc d", "en", "s", 7), (2, "a b\nc d", "en", "s", 7), (3, None, "en", "s", None), (4, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert sorted((r.doc_id, r.text, r.n_chars) for r in kept.collect() if r.text is not None) == [(1, "a b\nc d", 7), (4, "", 0)]
    assert [r.doc_id for r in kept.collect() if r.text is None] == [3]
    docs.select(*columns).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window", "source"]
