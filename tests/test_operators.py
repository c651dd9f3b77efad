"""Semantics traps and small fixtures of the operators and plans."""



import zipfile

import pytest
from pyspark.sql import functions as F

from granary.functions import parsing as P
from granary.operators import aggregates as A
from granary.operators import joins as J
from granary.operators import windows as V
from granary.operators.graph import components
from granary.plans import backtest as B
from granary.plans import pilot
from granary.plans import truth as T
from granary.sources import files as S
from granary.sources import reports


def one(spark, **cols):
    return spark.range(1).select(*[v.alias(k) for k, v in cols.items()]).first()


def test_numbers_and_dates(spark):
    lit = F.lit
    r = one(spark, a=P.number(lit("$1,250.5")), b=P.number(lit("7%")), c=P.number(lit("nan")), d=P.number(lit("x")), e=P.whole(lit("12.9")), f=P.date_of(lit("15-JAN-2023")), g=P.date_of(lit("1/5/2024")), h=P.date_of(lit("20240229")), i=P.flag(lit(" N ")), j=P.cik(lit("0000")), k=P.cik(lit(" 00123 ")))
    assert (r.a, r.b, r.c, r.d, r.e, str(r.f), str(r.g), str(r.h), r.i, r.j, r.k) == (1250.5, 0.07, None, None, 12, "2023-01-15", "2024-01-05", "2024-02-29", False, "0", "123")


def test_names(spark):
    r = one(spark, a=P.normalized_name(F.lit("  Café & Söhne, Ltd. ")), b=P.normalized_name(F.lit("Incorporate Inc")), c=P.investor_name(F.lit("The Alpha Capital Partners, LLC")), d=P.watchlist_name(F.lit("A--B  c")))
    assert (r.a, r.b, r.c, r.d) == ("cafe sohne", "incorporate", "alpha", "a b c")


@pytest.mark.parametrize(("y", "p", "want"), [([0, 1] * 5, [0.5] * 10, 0.0), ([0] * 5, [0.99] * 5, 0.99), ([1], [0.7], 0.3), ([], [], 0.0), ([1, 0], [1.0, 1.5], 0.0)])
def test_calibration(spark, y, p, want):
    df = spark.createDataFrame(list(zip(y, p, strict=True)), "y int, p double")
    assert A.calibration_error(df, "y", "p").first().ece == pytest.approx(want)
    bins = A.calibration(df, "y", "p").orderBy("bin").collect()
    assert len(bins) == 10 and all(b.mean_p is None for b in bins if b.n == 0)


def test_auc(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)] * 3, "y int, s double")
    assert A.auc(df, "y", "s").first().auc == pytest.approx(0.625)
    assert A.auc(df.where("y = 1"), "y", "s").first().auc == 0.0


def test_nan_never_passes(spark):
    nan = F.lit(float("nan"))
    r = one(spark, a=B.passed(nan, ">=", 0.65), b=B.passed(F.lit(None).cast("double"), "<", 0.1), c=B.passed(F.lit(0.65), ">=", 0.65), d=B.passed(F.lit(1.3), ">", 1.3))
    assert (r.a, r.b, r.c, r.d) == (False, False, True, False)


def test_capped_is_greedy(spark):
    rows = [(i, f"s{i % 3 if i % 5 else 0}", (i * 37) % 101) for i in range(60)]
    got = [r.id for r in V.capped(spark.createDataFrame(rows, "id int, sector string, score int"), "sector", 4, 9, [F.desc("score"), F.col("id")]).orderBy("pick").collect()]
    want, used = [], {}
    for i, s, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        if used.get(s, 0) < 4 and len(want) < 9:
            used[s] = used.get(s, 0) + 1
            want.append(i)
    assert got == want


def test_reconcile(spark):
    facts = [("r", "cap", 100.0, "sec", "2024-01-01", 1), ("r", "cap", 120.0, "blog", "2024-05-01", 2), ("r", "pre", 100.0, "sec", "2024-01-01", 3), ("r", "pre", 102.0, "manual", "2024-05-01", 4), ("r", "pre", None, "sec", "2025-01-01", 5), ("r", "fee", 5.0, "manual", "2024-01-01", 6), ("r", "fee", 9.0, "academic", "2023-01-01", 7)]
    df = spark.createDataFrame(facts, "k string, f string, v double, s string, d string, id int").withColumn("d", F.col("d").cast("date"))
    got = {r.f: r for r in T.reconcile(df, ["k", "f"], "v", "s", "d", "id").collect()}
    assert (got["cap"].value, got["cap"].conflict, round(got["cap"].confidence, 6)) == (100.0, "minor", 0.79)
    assert (got["pre"].value, got["pre"].conflict, got["pre"].n_facts) == (100.0, "none", 2)
    assert (got["fee"].value, got["fee"].conflict, round(got["fee"].confidence, 6)) == (5.0, "major", 0.45)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a int, b int")
    got = {r.id: r.root for r in components(links, "a", "b").collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_majority_ties_go_to_the_first_seen(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "a", 3), (1, "b", 4)], "k int, v string, o int")
    r = A.majority(df, ["k"], "v", "o").first()
    assert (r.majority, r.disagreement) == ("b", 0.5)


def test_zipped_tsv_and_join(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q.zip", "w") as z:
        z.writestr("a/SUBMISSION.tsv", "accession\tform\n1\t C \n2\tD\n")
        z.writestr("a/Issuers.TSV", "ACCESSION\tNAME\n1\tOld\n1\tNew\n2\tCaf\xe9\n".encode("latin-1"))
    sub = S.cells(S.zipped_tsv(spark, str(tmp_path / "*.zip"), "submission.tsv"), ["ACCESSION", "FORM", "NONE"])
    iss = S.cells(S.zipped_tsv(spark, str(tmp_path / "*.zip"), "ISSUERS.tsv"), ["ACCESSION", "NAME"])
    got = sorted((r.accession, r.form, r.none, r.name) for r in S.joined_filings(sub, [iss], "accession").collect())
    assert got == [("1", "C", "", "New"), ("2", "D", "", "Café")]


def test_synonyms_and_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text('Company Name,Amount Raised,amount_raised\n"A, Ltd",5,6\n')
    (tmp_path / "b.tsv").write_text("x\ty\n1\t2\n")
    df = S.csv_by_synonyms(spark, str(tmp_path / "a.csv"), {"name": ("firm", "company_name"), "raised": ("amount_raised",), "sector": ("sector",)})
    assert tuple(df.first()) == ("A, Ltd", "5", None)
    assert S.delimiter(spark, str(tmp_path / "b.tsv")) == "\t" and S.delimiter(spark, str(tmp_path / "a.csv")) == ","
    with pytest.raises(ValueError, match="missing columns: nope"):
        S.required(df, ["name", "nope"])


def test_sheets(spark, tmp_path):
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(tmp_path / "x.xlsx", "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst {ns}><si><t>Name</t></si><si><t>Assets</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {ns}><sheetData><row><c t="s"><v>0</v></c><c t="s"><v>1</v></c></row><row><c t="inlineStr"><is><t>A</t></is></c><c><v>5</v></c></row></sheetData></worksheet>')
    assert [(r.sheet, r.row, r.cells) for r in S.sheets(spark, str(tmp_path / "*.xlsx")).collect()] == [("sheet1", 0, ["Name", "Assets"]), ("sheet1", 1, ["A", "5"])]


def test_profiles_and_report(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"company_number": "1", "company_name": "A", "company_status": "Active", "date_of_creation": "2020-01-31", "accounts": {"overdue": true}, "officers": [{"name": "x"}, {"name": "y", "resigned_on": "2021-01-01"}]}\n{"company_number": "2"}\n')
    got = S.company_profiles(spark, str(tmp_path / "c.json"))
    assert [(r.company_number, r.status, str(r.created), r.overdue, r.officers) for r in got.orderBy("company_number").collect()] == [("1", "active", "2020-01-31", True, 1), ("2", None, "None", False, 0)]
    reports.write_report(got.select("company_number", "overdue").orderBy("company_number"), "Firms", str(tmp_path / "r"))
    assert (tmp_path / "r.md").read_text().splitlines()[2:5] == ["| company_number | overdue |", "|-|-|", "| 1 | True |"]
    with pytest.raises(ValueError, match="rows at most"):
        reports.write_report(spark.range(2000), "Too long", str(tmp_path / "s"))


def test_streams(spark, tmp_path):
    from granary.streaming import events as E

    rows = [(i, f"2024-01-01 0{i % 5}:1{i % 6}:00", i % 3, "view" if i % 2 else "click", float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = E.run_once(E.tumbling(stream(), "1 hour", "1 hour"), "hourly", str(tmp_path / "c1"), "update")
    last = {(r.start, r.event_type): (r.n, r.total) for r in got.collect()}
    assert last == {(r.start, r.event_type): (r.n, r.total) for r in E.tumbling(df, "1 hour").collect()}
    keyed = stream().withColumn("dedupe_key", (F.col("event_id") % 4).cast("string"))
    assert E.run_once(E.alerts_once(keyed, "12 hours"), "alerts", str(tmp_path / "c2")).count() == 4


def test_walk_forward_training_has_precedence(spark):
    df = spark.createDataFrame([("2020-01-01",), ("2021-01-01",), ("2023-01-01",)], "d string").withColumn("d", F.col("d").cast("date"))
    got = sorted((str(r.d), r.window, r.split) for r in V.walk_forward(df, "d", [("a", "2020-06-30", "2020-01-01", "2021-06-30")]).collect())
    assert got == [("2020-01-01", "a", "train"), ("2021-01-01", "a", "test")]


def test_archives_and_signals(spark, tmp_path):
    assert S.quarter_archive(2024, 3) == "2024q3.zip"
    for year, quarter in ((2016, 1), (2024, 5)):
        with pytest.raises(ValueError, match="no archive"):
            S.quarter_archive(year, quarter)
    (tmp_path / "s.json").write_text('{"company_id": 1, "observed": "2024-01-02", "grants": 3}\n{"company_id": 2, "observed": "bad", "patents": 1}\n')
    assert [(r.company_id, r.signal, r.value) for r in S.official_signals(spark, str(tmp_path / "s.json")).collect()] == [(1, "grants", 3.0)]


def test_models(spark):
    rows = [(i, int(i % 4 == 0), float(i % 4), float(i * 7 % 10)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")
    scored = B.trained(df.where("id < 300"), df.where("id >= 300"), ["a", "b"], "id", "y", calibrate=False)[0]
    area = lambda d: A.auc(d.withColumn("s", -F.col("a") + 0 * F.col("b")), "y", "s").first().auc
    assert A.auc(scored, "y", "p_failed").first().auc == 1.0 and {c for c in ("p_failed", "score")} <= set(scored.columns)
    fall = B.permutation_importance(area, df, ["a", "b"], "id", repeats=2)
    assert fall["a"] > 0.2 and fall["b"] == 0.0
    assert B.progress_model(df.where("y = 1"), df, ["a"], "id", "y") is None


def test_tree_json_scores_like_the_model(spark):
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    df = spark.createDataFrame([(float(i % 7), float(i % 5), int((i % 7) > 3)) for i in range(200)], "a double, b double, y int")
    x = VectorAssembler(inputCols=["a", "b"], outputCol="x").transform(df)
    model = GBTClassifier(labelCol="y", featuresCol="x", maxIter=3, maxDepth=2, seed=1).fit(x)
    out = reports.tree_json(model, ["a", "b"])
    assert len(out["trees"]) == 3 and len(out["weights"]) == 3 and out["trees"][0]["feature"] in ("a", "b")


def test_diverse_selection(spark):
    from granary.plans import pilot

    rows = [(1, "x", "s", "UK", 9.0), (2, "x", "s", "UK", 8.5), (3, "y", "s", "UK", 5.0), (4, "x", "t", "UK", 7.0), (5, None, None, None, 1.0)]
    got = pilot.diverse(spark.createDataFrame(rows, "id long, class string, sector string, country string, evidence double"), 4).orderBy("pick").collect()
    assert [r.id for r in got] == [1, 3, 5, 4]


def test_names_and_terms(spark):
    names = ["Foo SARL", "Foo L.L.C.", "Foo LP", "Łódź Œuvre Ltd", "Straße  GmbH.", "A Pvt", "Foo Ltd Inc", "Ærø Co"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(P.normalized_name(F.col("n"))).collect()]
    assert got == ["foo", "foo", "foo lp", "lodz oeuvre", "strasse", "a", "foo ltd", "aero"]
    texts = [
        "We are raising on a SAFE with a valuation cap of $10 million and a 20% discount.\nThe pre-money valuation is $8,000,000 and post-money valuation is $10,000,000.\nInvestors have pro rata rights and 1x liquidation preference.\nThis round is led by Example Ventures.\n",
        "No pro rata rights are granted to noteholders.",
        "20% discount. 5% interest",
        "Discount rate: 15%; interest of 8.5%. Matures on 2027-01-31. Non-participating. Liquidation preference of 2x.",
        "Maturity date: March 3, 2027. Participating preferred.",
        None,
    ]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = [r.asDict() for r in df.select(*[v.alias(k) for k, v in P.terms(F.col("t")).items()]).collect()]
    assert rows[0] == {"valuation_cap": 1e7, "pre_money": 8e6, "post_money": 1e7, "discount_rate": 0.2, "interest_rate": None, "maturity_date": None, "liquidation_pref": 1.0, "participation": None, "pro_rata": True, "lead_investor": "Example Ventures"}
    assert rows[1]["pro_rata"] is False and (rows[2]["discount_rate"], rows[2]["interest_rate"]) == (0.2, 0.05)
    assert (rows[3]["discount_rate"], rows[3]["interest_rate"], rows[3]["maturity_date"], rows[3]["participation"], rows[3]["liquidation_pref"]) == (0.15, 0.085, "2027-01-31", "non_participating", 2.0)
    assert (rows[4]["maturity_date"], rows[4]["participation"]) == (None, "participating") and set(rows[5].values()) == {None}
    filing = df.select(*[v.alias(k) for k, v in P.filing_terms(F.lit("a 20% discount and a valuation cap of $12000000. 1x liquidation preference and pro rata rights")).items()]).first()
    assert (filing.valuation_cap, filing.discount_rate, filing.liquidation_pref, filing.pro_rata, filing.participation) == (12e6, 0.2, 1.0, True, None)
    page = spark.createDataFrame([("<p>Caf&#233; &#8212; &apos;&#128512;&#55555;</p>",)], "h string").select(P.html_text(F.col("h"))).first()[0]
    assert page == "Café — '\U0001f600�"


def test_asof_on_a_hot_key(spark):
    import datetime
    import random

    rng, day = random.Random(3), lambda n: datetime.date(2020, 1, 1) + datetime.timedelta(days=n)
    pick = lambda: rng.choice(["hot", "hot", "hot", "a", None])
    left = [(i, pick(), day(rng.randrange(200)) if rng.random() > 0.05 else None) for i in range(400)]
    right = [(i, pick(), day(rng.randrange(200)) if rng.random() > 0.05 else None, float(i) if i % 5 else None) for i in range(300)]
    l, r = spark.createDataFrame(left, "id long, k string, d date"), spark.createDataFrame(right, "rid long, k string, filed date, v double")  # noqa: E741
    for strict, hot in ((False, True), (True, True), (False, False), (True, False)):
        got = {x.id: (x.filed, x.rid, x.v) for x in J.asof(l, r, "k", "d", "filed", ["rid", "v"], "rid", "id", strict, hot).collect()}
        for i, k, d in left:
            hits = [x for x in right if k and d and x[1] == k and x[2] and (x[2] < d if strict else x[2] <= d)]
            best = max(hits, key=lambda x: (x[2], x[0]), default=None)
            assert got[i] == ((best[2], best[0], best[3]) if best else (None, None, None)), (i, strict)
    sums = {x.id: x.total for x in J.prior_sum(l, r, "k", "id", "d", "filed", "v", "total").collect()}
    for i, k, d in left:
        hits = [x[3] for x in right if k and d and x[1] == k and x[2] and x[2] < d and x[3] is not None]
        assert (sums[i] is None and not hits) or abs(sums[i] - sum(hits)) < 1e-6
    plan = J.asof(l, r, "k", "d", "filed", ["rid", "v"], "rid", "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "<=" not in plan  # no pairs of rows with a condition on their times


def test_diverse_choice_is_exact(spark):
    import random

    rng = random.Random(4)
    rows = [(i, rng.choice("abc"), rng.choice([None, "s", "t"]), rng.choice("uvw"), float(rng.randrange(40))) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, class string, sector string, country string, evidence double")
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    chosen = sorted((next(r for r in order if r[1] == c) for c in "abc"), key=lambda r: (-r[4], r[0]))
    while len(chosen) < 12:
        new = lambda r: sum(w for w, j in ((3, 1), (2, 2), (1, 3)) if r[j] is not None and r[j] not in {c[j] for c in chosen})
        chosen.append(min((r for r in rows if r not in chosen), key=lambda r: (-(r[4] + new(r)), r[0])))
    assert [r.id for r in pilot.diverse(df, 12).orderBy("pick").collect()] == [r[0] for r in chosen]


def test_published_datasets(spark, tmp_path):
    path = tmp_path / "d.csv"
    path.write_text('Startup Name,Raised EUR,amount_raised,Industry,Failure,Notes\n"A, Inc",5,6,fintech,1,x\n')
    r = S.dataset(spark, str(path), "kleinert").first()
    assert (r["name"], r.amount_raised, r.sector, r.failure_flag, r.notes, r.country) == ("A, Inc", "5", "fintech", "1", "x", None)
    assert all(len(v) >= 14 for v in S.DATASETS.values())


def test_trained_models_are_calibrated_and_chosen(spark):
    import random

    rng = random.Random(8)
    make = lambda i: (i, int(rng.random() < (0.08 + 0.5 * (x := rng.random()) ** 2)), x, rng.random())
    rows = [make(i) for i in range(1600)]
    rows = [(i, y, x, z) for i, y, x, z in rows]
    df = spark.createDataFrame(rows, "deal_id long, failed int, a double, b double").coalesce(2)
    train, test = df.where("deal_id < 1000").cache(), df.where("deal_id >= 1000").cache()
    plain, _, _ = B.trained(train, test, ["a", "b"], "deal_id", calibrate=False)
    done, best, areas = B.trained(train, test, ["a", "b"], "deal_id")
    done = done.cache()
    assert set(areas) == {"boosted", "forest", "ensemble"} and areas[best] == max(areas.values()) > 0.6
    before, after = (A.calibration_error(x, "failed", "p_failed").first().ece for x in (plain, done))
    assert after < 0.08 and after < before
    assert done.count() == test.count() and done.where("p_failed < 0 or p_failed > 1").count() == 0
    few, _, _ = B.trained(train.limit(150), test, ["a", "b"], "deal_id")  # a sigmoid fit
    assert few.where("p_failed between 0 and 1").count() == test.count()


def test_preferred_makes_no_pairs_of_a_hot_key(spark):
    left = spark.range(2000).select("id", (F.col("id") % 3).alias("k")).unionByName(spark.createDataFrame([(5000, None)], "id long, k long"))
    right = spark.range(3000).select((F.col("id") + 10).alias("rid"), (F.col("id") % 2).alias("k"))
    ways = [(right.where("rid < 1000"), F.col("id"), F.col("rid")), (right, F.col("k"), F.col("k"))]
    done = J.preferred(left, "id", ways, ["rid"], ["rid"])
    got = {r.id: (r.rid, r.pref) for r in done.collect()}
    want = {i: (i, 0) if 10 <= i < 1000 else (10 + i % 3, 1) if i % 3 < 2 else (None, None) for i in range(2000)}
    assert got == want | {5000: (None, None)}
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 3  # one right row for each key before each join, and the best way after them


def test_models_start_from_rows_computed_once(spark):
    rows = spark.range(600).select(F.col("id").alias("deal_id"), (F.col("id") % 3 == 0).cast("int").alias("failed"), (F.col("id") % 7).cast("double").alias("a"), F.lit("s").alias("s"), F.lit(1).alias("more"))
    assert B.matrix(rows, ["a"], ["s"], ("more",)).columns == ["deal_id", "failed", "a", "s", "more"]
    done = B.trained(rows.where("deal_id < 400"), rows.where("deal_id >= 400"), ["a"], "deal_id", calibrate=False)[0]
    assert "Range" not in done._jdf.queryExecution().optimizedPlan().toString()
    assert done.count() == 200


def test_terms_are_read_in_chosen_texts_alone(spark):
    from granary.plans import spine

    r = spark.createDataFrame([(1, 1, "7", "US")], "round_id long, company_id long, cik string, country string").withColumn("round_date", F.lit("2020-01-01").cast("date"))
    t = spark.range(50).select(F.col("id").alias("text_id"), F.lit(1).alias("company_id"), F.lit("7").alias("cik"), F.date_add(F.lit("2019-01-01").cast("date"), F.col("id").cast("int")).alias("filed"), F.rpad(F.lit("a valuation cap of $5 million; "), 200, "x").alias("text"))
    done = spine.narrative_terms(r, t)
    assert [(x.text_id, x.number) for x in done.collect()] == [(49, 5e6)]
    assert "LeftSemi" in done._jdf.queryExecution().optimizedPlan().toString()


def test_xml_fields_are_read_at_once(spark):
    rows = [(1, '<n1:a xmlns:n1="u"><n1:b>x\ny</n1:b><c>2</c></n1:a>'), (2, "<a><c>3</c><c>4</c></a>"), (3, None), (4, "<a><b></b></a>")]
    df = spark.createDataFrame(rows, "id long, x string").select("id", S.xml_fields(F.col("x"), ["a/b/text()", "a/c/text()", "a/d/text()"]).alias("f"))
    assert {r.id: r.f for r in df.collect()} == {1: ["x\ny", "2", None], 2: [None, "3", None], 3: None, 4: [None, None, None]}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("XPathStringEvaluator") == 1


def test_index_lines_match_each_line_twice_at_most(spark):
    line = "C           Firm  A, x   12  2020-01-02  edgar/1.txt  "
    df = spark.createDataFrame([(line,), ("C",), ("C\n1\n2\n3\n4",), (None,), ("",), (line.replace("C  ", "D  "),)], "value string")
    read = S.index_lines(df)
    assert [tuple(r) for r in read.collect()] == [("C", "Firm  A, x", "12", "2020-01-02", "edgar/1.txt")]
    plan = read._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") + plan.count("regexp_") == 2


def test_side_by_side_joins_nothing(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, None)], "k long, a string"), spark.createDataFrame([(2, 5.0), (3, None)], "k long, b double")
    done = J.side_by_side([a, b], "k")
    assert {tuple(r) for r in done.select("k", "a", "b").collect()} == {(1, "x", None), (2, None, 5.0), (3, None, None)}
    assert "Join" not in done._jdf.queryExecution().optimizedPlan().toString()
