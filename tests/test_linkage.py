"""Names that contain others, records without labels, merges over tables, and reads of intervals, against plain loops."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from granary.operators import containment as N
from granary.operators import intervals as V
from granary.plans import entities as E
from granary.plans import labels as L
from granary.plans import linkage as K
from granary.plans import spine


def test_containing_equals_a_plain_loop(spark):
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choice("abc d") for _ in range(rnd.randrange(0, 14)))) for i in range(300)]
    texts += [(1000 + i, f"common stem {i % 40}") for i in range(400)] + [(5000, None), (5001, "")]  # a gram that most texts have
    needles = [(i, t[1:6] if t else t) for i, t in texts[:200]] + [(9000, "a"), (9001, "ab"), (9002, "stem"), (9003, "art co"), (9004, "zzz"), (9005, None), (9006, "")]
    texts.append((7000, "smart co"))
    left, right = spark.createDataFrame(needles, "id long, needle string"), spark.createDataFrame(texts, "tid long, text string")
    want = {n: min(i for i, t in texts if t and n in t) for _, n in needles if n and any(t and n in t for _, t in texts)}
    for part in (20_000, 7):
        got = {r["_needle"]: r["_best"]["tid"] for r in N.containing(left, right, "needle", "text", [F.col("tid")], part).collect()}
        assert got == want and got["art co"] == 7000
    plan = N.containing(left, right, "needle", "text", [F.col("tid")])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_names_prefer_the_same_one_then_the_best(spark):
    left = spark.createDataFrame([(1, "Acme"), (2, "cme ho"), (3, ""), (4, None), (5, "nothing")], "id long, name string")
    right = spark.createDataFrame([(10, "Acme Holdings", 1.0), (11, "ACME", 0.0), (12, "The acme house", 9.0), (13, "", 5.0)], "rid long, full string, size double")
    got = {r.id: (r.rid, r.how) for r in N.by_name(left, right, "id", F.lower("name"), F.lower("full"), ["rid"], [F.col("rid")], [(-F.col("size")).alias("less"), F.col("rid")]).collect()}
    assert got == {1: (11, "exact"), 2: (12, "contains"), 3: (None, None), 4: (None, None), 5: (None, None)}


def test_investors_take_the_best_tier_then_assets(spark):
    leads = spark.createDataFrame([(1, "Oak Hill Partners"), (2, "Oak Hill"), (3, "Capital Partners")], "id long, lead string")
    refs = spark.createDataFrame([(1, "Oak Hill Growth LLC", "B", 9.0), (2, "Old Oak Hill Fund", "A", 1.0), (3, "Oak Hill Fund", "A", 5.0), (4, "Oak Hill Fund Two", "A", None)], "ref_id long, legal string, tier string, assets double")
    got = {r.id: (r.ref_id, r.how, r.quality) for r in E.investor_references(leads, refs, "id", "lead", "legal").collect()}
    assert got == {1: (3, "contains", 1.0), 2: (3, "contains", 1.0), 3: (None, None, None)}


def test_resolve_tells_scripts_apart_and_matches_no_nulls(spark):
    rows = [
        (1, "s", "1", "Альфа", "RU"), (2, "s", "2", "Бета", "RU"), (3, "s", "3", "Alfa Ltd.", "ru"), (4, None, None, "Foo", "UK"), (5, None, None, "Bar", "UK"), (6, "s", "6", None, "UK"), (7, "s", "7", None, "UK"),
        (8, "s", "8", "--", "UK"), (9, "s", "1", "Other name", "UK"), (10, "s", "10", "北京", "CN"), (11, "s", "11", "上海", "CN"), (12, "s", "12", "Foo", None), (13, "s", "13", "Foo", None), (14, "x", None, "foo", "uk"),
    ]
    df = spark.createDataFrame(rows, "ord long, source string, sid string, name string, country string").withColumns({"_name": F.lit(0), "_lead": F.lit(0)})
    got = {r.ord: (r.entity_id, r.how) for r in E.resolve(df.drop("_name", "_lead"), "ord", "source", "sid", "name", "country").collect()}
    assert got == {**{i: (i, "created") for i in range(1, 14)}, 3: (1, "name_country"), 9: (1, "source_id"), 14: (4, "name_country")}


NAMES = [(1, "Acme Widgets Ltd", "UK"), (2, "Akme Widgets", "uk"), (3, "Zenith Labs", "US"), (4, "Acme Widgets", "UK"), (5, "Other Thing", "US"), (6, "Zenith Lab", "US"), (7, None, "UK"), (8, "", "UK"), (9, "Borealis", "FR"), (10, "Quantum Foods", "DE"), (11, "Quantum Food", "DE")]


def test_linkage_finds_slips_without_labels(spark):
    df = spark.createDataFrame(NAMES, "id long, name string, b string")  # a field may be named like the operator's own
    links = K.linked(df, "id", "name", ["b"])
    got = {(r.a, r.b): r.score for r in links.collect()}
    assert set(got) == {(1, 2), (1, 4), (3, 6), (10, 11)} and got[1, 4] == 1.0 and all(0.5 <= v <= 1 for v in got.values())
    clusters = {r.id: (r.root, r.merged) for r in K.clusters(links).collect()}
    assert {i for i, (root, _) in clusters.items() if root == 1} == {1, 2, 4} and clusters[6] == (3, True)
    assert {(r.a, r.b) for r in K.linked(df, "id", "name", ["b"], tile=2).collect()} == set(got)  # blocks cut into tiles
    assert K.linked(df.limit(0), "id", "name", ["b"]).count() == 0


def test_linkage_of_many_records(spark):
    rnd, rows = random.Random(4), []
    word = lambda n: "".join(rnd.choice("abcdefghijklmnoprstuvw") for _ in range(n))
    for i in range(300):
        name, place = f"{word(8)} {word(6)}", rnd.choice(["UK", "US", "FR", "DE", "ES"])
        rows.append((2 * i, name, place))
        if i % 3 == 0:
            at = rnd.randrange(1, 7)
            rows.append((2 * i + 1, name[:at] + name[at + 1 :], place if i % 4 else None))
    links = K.linked(spark.createDataFrame(rows, "id long, name string, place string"), "id", "name", ["place"]).collect()
    truth = {(2 * i, 2 * i + 1) for i in range(0, 300, 3)}
    got = {(r.a, r.b) for r in links}
    assert len(got & truth) >= 0.97 * len(truth) and len(got - truth) <= 2


def test_linkage_counts_pairs_that_agree_in_nothing(spark, monkeypatch):
    rnd = random.Random(8)
    part = lambda n, letters="aeiouyhw": "".join(rnd.choice(letters) for _ in range(n))
    names = ["b" + part(7) + " d" + part(5) for _ in range(70)]  # one sound: all pairs share a block
    names += [n[:3] + n[4:] for n in names[:9]] + [" ".join(reversed(n.split())) for n in names[9:14]] + [f"q{part(3, 'rstlm')} rare k{part(3, 'xzvf')}" for _ in range(6)] + ["b", "bé ü", "b c d", "b c"]
    rows = [(i, n, rnd.choice(["UK", "US", None]), rnd.choice(["x", "y", "z", None])) for i, n in enumerate([*names, names[0], names[1]])]
    df = spark.createDataFrame(rows, "id long, name string, place string, sector string")
    recs = K.records(df, "id", "name", ["place", "sector"]).groupBy("_n", "_f").agg(F.min("_id").alias("_id"))
    held = sorted(((r._id, r._n, list(r._f), list(r._keys)) for r in K.keyed(recs).collect()), key=lambda r: r[0])

    def edits(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row = [i]
            for j, y in enumerate(b, 1):
                row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
            last = row
        return last[-1]

    want, pairs = {}, set()
    for i, (a, n, f, keys) in enumerate(held):
        for b, m, g, others in held[i + 1 :]:
            x, y = set(n.split()), set(m.split())
            rare = any(1 < sum(w in h[1].split() for h in held) <= K.RARE for w in x & y)
            if rare or any(k == o for k, o in zip(keys, others, strict=True)):
                close, share = 1 - edits(n, m) / max(len(n), len(m)), len(x & y) / len(x | y)
                p = (3 if n == m else 2 if close >= 0.85 else 1 if close >= 0.7 else 0, 2 if share >= 1 else 1 if share >= 0.5 else 0, *[-1 if None in (u, v) else int(u == v) for u, v in zip(f, g, strict=True)])
                want[p] = want.get(p, 0) + 1
                pairs.add((a, b))
    got, estimate = [], K.estimate
    monkeypatch.setattr(K, "estimate", lambda counts: got.append(counts) or estimate(counts))
    for tile in (K.TILE, 7):
        links = [(r.a, r.b) for r in K.linked(df, "id", "name", ["place", "sector"], 0.0, tile).collect()]
        assert got.pop() == want and len({*links} & pairs) == len(pairs) and len(links) == len({*links})  # nothing is too little: all pairs are made
    made = K.compared(K.keyed(recs), 2)
    assert made.where("not again").count() < len(pairs) / 2  # most are only counted


def test_weights_come_from_the_patterns():
    share, match, other = K.estimate({(3, 2, 1): 90, (2, 1, 1): 10, (0, 0, 0): 800, (0, 0, 1): 100, (3, 2, -1): 5})
    assert 0.08 < share < 0.14 and match[0][3] > 0.7 and other[0][0] > 0.9 and match[2][1] > 0.9 > other[2][1]
    assert K.estimate({}) == (0.0, [], [])


def test_ranges_equal_a_plain_loop(spark):
    rnd = random.Random(7)
    start = datetime.date(1969, 1, 1)
    day = lambda: start + datetime.timedelta(days=rnd.randrange(0, 3000))
    right = [(1 if i % 3 else rnd.randrange(2, 9), day(), rnd.random()) for i in range(1500)] + [(1, None, 5.0), (None, day(), 5.0)]  # a key with two thirds of all rows
    left = [(i, 1 if i % 2 else rnd.randrange(2, 12), *sorted([day(), day()])) for i in range(300)]
    left += [(900, 1, datetime.date(1970, 1, 2), datetime.date(1970, 1, 1)), (901, 1, None, day()), (902, None, day(), day()), (903, 1, datetime.date(1, 1, 1), datetime.date(9999, 12, 31))]
    a = spark.createDataFrame(left, "id long, k long, low date, high date")
    b = spark.createDataFrame(right, "k long, at date, v double")
    got = {r.id: (r.n, r.most) for r in V.ranged(a, b, "k", F.col("low"), F.col("high"), "at", "id", "v").collect()}
    want = {}
    for i, k, low, high in left:
        hits = [v for kk, d, v in right if low and high and k is not None and kk == k and d and low <= d <= high]
        if hits:
            want[i] = (len(hits), max(hits))
    assert got == want


def test_terms_prefer_the_own_company(spark):
    long = "The offering is made under the usual rules and this text goes on for a while so that it is long enough to be read; " * 2
    texts = [
        (1, 5, "0077", "2020-01-01", long + "a valuation cap of $5 million; "), (2, None, "77", "2021-06-01", long + "a discount rate of 15%; "), (3, 5, "77", "2023-01-01", long + "pro rata rights; "),
        (4, 5, "77", "2021-12-01", "too short: a valuation cap of $9 million"), (5, None, "88", "2020-01-01", long + "led by Example Ventures; "),
    ]
    t = spark.createDataFrame(texts, "text_id long, company_id long, cik string, filed string, text string").withColumn("filed", F.col("filed").cast("date"))
    rounds = [(1, 5, "77", "2022-01-01", "US"), (2, 6, "77", "2022-01-01", "US"), (3, 5, "77", None, "US"), (4, 5, "77", "2022-01-01", "UK"), (5, 9, "088", "2019-01-01", "US"), (6, 9, "088", "2020-01-01", "US")]
    r = spark.createDataFrame(rounds, "round_id long, company_id long, cik string, round_date string, country string").withColumn("round_date", F.col("round_date").cast("date"))
    got = {(x.round_id, x.field, x.number, x.said, x.text_id) for x in spine.narrative_terms(r, t).collect()}
    assert got == {(1, "valuation_cap", 5e6, None, 1), (2, "discount_rate", 0.15, None, 2), (3, "pro_rata", None, "true", 3), (6, "lead_investor", None, "Example Ventures", 5)}


def test_merges_follow_chains_over_all_tables(spark):
    merges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11)], "keep_id long, merge_id long")
    rows = spark.createDataFrame([(i, f"r{i}") for i in (1, 2, 3, 4, 5, 11)], "entity_id long, root string")
    names = [*E.DROPPING, *E.MOVING]
    tables = {n: rows for n in names} | {"canonical_entities": rows.withColumnRenamed("entity_id", "id"), "other": rows}
    done = E.merged_tables(tables, merges)
    for n in names:
        got = sorted((r.entity_id, r.root) for r in done[n].collect())
        assert got == ([(1, "r1"), (5, "r5")] if n in E.DROPPING else [(1, "r1"), (1, "r2"), (1, "r3"), (1, "r4"), (5, "r5"), (10, "r11")])
    assert sorted(r.id for r in done["canonical_entities"].collect()) == [1, 5] and done["other"].count() == 6
    assert E.left_over({n: done[n] for n in [*names, "canonical_entities"]}, merges) == dict.fromkeys([*names, "canonical_entities"], 0)
    with pytest.raises(ValueError, match="circle"):
        E.resolved(spark.createDataFrame([(1, 2), (2, 1)], "keep_id long, merge_id long"))


def test_labels_are_rebuilt_by_source(spark):
    firms = spark.createDataFrame([(1, "companies_house", "Active"), (2, "companies_house", "dissolved"), (3, "companies_house", None), (4, "sec_edgar", None), (5, "sec_edgar", None), (6, "web", None), (7, "web", None)], "company_id long, source string, status string")
    told = spark.createDataFrame([(1, "failed", "x", 3), (2, "trading", "x", 3), (3, "trading", "x", 1), (4, "failed", "x", 3), (5, "trading", "x", 3), (6, "trading", "x", 3), (7, "unknown", "x", 1)], "company_id long, outcome string, detail string, tier int")
    got = {r.company_id: (r.outcome, r.tier) for r in L.rebuilt(told, firms).collect()}
    assert got == {1: ("trading", 1), 2: ("failed", 1), 3: ("unknown", 3), 4: ("failed", 1), 5: ("trading", 2), 6: ("trading", 3), 7: ("unknown", 3)}
