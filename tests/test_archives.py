"""Archives read by ranges, notices joined by their rules, the run log, and permutations by rank."""

import tracemalloc
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.plans import backtest as B
from granary.plans import runs as H
from granary.sources import archives as A
from granary.sources import files as S


def test_ranges_give_each_line_once(spark, tmp_path):
    text = "Id\tName\r\n" + "".join(f"{i}\t name {i} {'x' * (i % 37)}\r\n" for i in range(3000))
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("d/BIG.TSV", "﻿" + text)
        z.writestr("d/empty.tsv", "")
        z.writestr("d/head.tsv", "Id\tName")
        z.writestr("other.csv", 'A,B\n"x, y",Caf\xe9\n'.encode("latin-1"))
    want = [(i, str(i), f"name {i} {'x' * (i % 37)}".strip()) for i in range(3000)]
    for size in (1 << 26, 1000, 17):
        rows = A.zipped_lines(spark, str(tmp_path / "*.zip"), ".tsv", size=size) if size > 500 else None
        if rows is None:
            reader = A.ArchiveReader({"files": '["%s"]' % (tmp_path / "a.zip"), "member": "big.tsv", "range": "997"})
            got = [(r["line"], dict(r["cells"])["ID"], dict(r["cells"])["NAME"]) for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
        else:
            assert rows.rdd.getNumPartitions() >= (2 if size == 1000 else 1)
            got = [(r.line, r.cells["ID"], r.cells["NAME"]) for r in rows.collect()]
        assert sorted(got) == want
    auto = A.zipped_lines(spark, str(tmp_path / "*.zip"), "other.csv", "auto").first()
    assert auto.cells == {"A": "x, y", "B": "Café"}


def test_large_members_are_streams(tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w", zipfile.ZIP_DEFLATED) as z, z.open("big.tsv", "w", force_zip64=True) as f:
        f.write(b"id\ttext\n")
        for i in range(200):  # 200 MB
            f.write((f"{i}\t" + "y" * 1000 + "\n").encode() * 1000)
    reader = A.ArchiveReader({"files": '["%s"]' % (tmp_path / "a.zip"), "member": "big.tsv", "range": str(40 << 20)})
    parts = reader.partitions()
    assert len(parts) == 5
    tracemalloc.start()
    n = sum(b.num_rows for b in reader.read(parts[4]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 0 < n <= 42_000 and peak < 60 << 20


def test_notices_keep_their_own_columns(spark):
    make = lambda rows, names: spark.createDataFrame(rows, ", ".join(f"{n} {'long' if n == 'line' else 'string'}" for n in names))
    issuers = make([("1", "A", "", "own", 0), ("2", "B", "x", "own", 1), ("", "C", "x", "own", 2)], ["accessionnumber", "entityname", "filing_date", "sale_date", "line"])
    subs = make([("1", "2024-01-01", "D", "100", 0), ("1", "2024-02-02", "D/A", "200", 1)], ["accessionnumber", "filing_date", "submissiontype", "sic_code", "line"])
    offs = make([("1", "", "5", 0)], ["accessionnumber", "sale_date", "totalamountsold", "line"])
    got = {r.entityname: (r.filing_date, r.submissiontype, r.sic_code, r.sale_date, r.totalamountsold) for r in S.notice_filings(issuers, subs, offs).collect()}
    assert got == {"A": ("", "D/A", "200", "", "5"), "B": ("x", None, None, "own", None)}


def test_runs_are_logged_once(spark, tmp_path):
    path = str(tmp_path / "runs")
    gates = spark.createDataFrame([("w1", "auc", 0.7, True, True), ("w1", "ece", 0.2, False, False), ("w2", "auc", 0.5, False, True)], "window string, metric string, value double, passed boolean, must_pass boolean")
    made = H.from_gates(gates, "window", "uk", ["b", "a"], "2024-01-01")
    assert H.log(spark, path).count() == 0
    assert H.record(made, path) == 2 and H.record(made, path) == 0  # a replay adds nothing
    assert H.record(H.from_gates(gates, "window", "uk", ["a", "b"], "2024-01-01"), path) == 0  # the order of features doesn't count
    assert H.record(H.from_gates(gates, "window", "us", ["a"], "2024-01-01").unionByName(made), path) == 2
    runs = H.log(spark, path)
    assert runs.count() == 4 and {(r.model_family, r.all_passed) for r in runs.collect()} == {("uk", True), ("uk", False), ("us", True), ("us", False)}
    assert H.latest(runs, ["model_family"], 1).count() == 2 and {r.test_window for r in H.latest(runs, ["model_family"], 5, passing=True).collect()} == {"test_window:w1"}
    uk = {r.test_window: r.run_id for r in runs.where("model_family = 'uk'").collect()}
    got = {r.metric: (r.before, r.after, r.delta, r.before_passed) for r in H.compared(runs, uk["test_window:w1"], uk["test_window:w2"]).collect()}
    assert got["ece"] == (0.2, None, None, True) and abs(got["auc"][2] + 0.2) < 1e-9
    with pytest.raises(ValueError, match="not found"):
        H.compared(runs, "nope", uk["test_window:w1"])


def test_permutations_equal_numpys(spark):
    df = spark.createDataFrame([(i, i * 10) for i in range(500)], "id long, v long").repartition(7)
    rank = {r.id: r.r for r in B.ranked(df, [F.desc("v")], "r").collect()}
    assert rank == {i: 499 - i for i in range(500)}
    hashes = df.select("id", F.xxhash64(F.lit(3), "id").alias("a"), F.xxhash64(F.lit(-4), "id").alias("b")).orderBy("id").toPandas()
    givers, takers = np.lexsort((hashes["id"], hashes["a"])), np.lexsort((hashes["id"], hashes["b"]))
    want = dict(zip(hashes["id"][takers], hashes["id"][givers] * 10, strict=True))
    assert {r.id: r.v for r in B.permuted(df, "v", "id", 3).collect()} == want


def test_landed_histories_and_filings(spark, tmp_path):
    from granary.sources import landed as D

    (tmp_path / "h.json").write_text(
        '{"company_number": "01", "extra": 1, "items": [{"type": "SH01", "date": "2024-03-01", "transaction_id": "t1", "links": {"self": "/x"}, "description_values": {"nominal_value_per_share": "0.5", "number_allotted": 1000}}, {"type": "CS01", "date": "2024-03-02"}, {"type": "sh01", "action_date": "2024-04-01", "barcode": "b2", "description_values": {"amount": "70"}}, {"type": "SH01", "date": "2024-05-01", "barcode": "b3"}]}\n{"company_number": "02", "items": [{"type": "SH01", "date": "2024-01-01"}]}\n{"company_number": "03"}\n'
    )
    firms = spark.createDataFrame([("01", 7, None, "tech"), ("03", 9, "UK", "tech")], "company_number string, company_id long, country string, sector string")
    rounds = D.allotments(D.histories(spark, str(tmp_path / "h.json")), firms)
    got = {r.record_id: (r.company_id, r.country, str(r.round_date), r.amount, r.round_key) for r in rounds.collect()}
    assert got == {
        "t1": (7, "UK", "2024-03-01", 500.0, "7:2024-03-01:uk_share_allotment:equity:500.00"), "b2": (7, "UK", "2024-04-01", 70.0, "7:2024-04-01:uk_share_allotment:equity:70.00"), "b3": (7, "UK", "2024-05-01", None, "7:2024-05-01:uk_share_allotment:equity:unknown"),
    }
    facts = {(r.record_id, r.field): r.said for r in D.allotment_facts(rounds).collect()}
    assert facts["t1", "amount_raised"] == "500.00" and facts["b3", "round_date"] == "2024-05-01" and ("b3", "amount_raised") not in facts
    (tmp_path / "s.json").write_text('{"cik": "0000000077", "filings": {"recent": {"form": ["10-K", "S-1", "8-K"], "accessionNumber": ["a-0", "a-1-2", "a-3"], "primaryDocument": ["x", "y.htm", "z"], "filingDate": ["2024-01-01", "2024-02-02", "2024-03-03"]}}}\n{"cik": "5", "filings": {"recent": {"form": ["10-K"], "accessionNumber": ["b"], "primaryDocument": ["x"], "filingDate": ["2024-01-01"]}}}\n{"cik": "6"}\n')
    filings = D.late_filings(D.submissions(spark, str(tmp_path / "s.json")))
    assert [tuple(map(str, r)) for r in filings.collect()] == [("77", "S-1", "a12", "y.htm", "2024-02-02")]
    rounds = spark.createDataFrame([(1, 77, "US", "seed", 6e6), (2, 77, "US", "early_growth", 1.0), (3, 77, "US", "seed", 1.0), (4, 77, "UK", "early_growth", 9e6)], "round_id long, cik long, country string, stage string, amount double")
    docs = spark.createDataFrame([("a12", "with a 1.5x liquidation preference and pro rata rights")], "accession string, text string")
    got = {(r.round_id, r.field, r.said, r.record_id) for r in D.late_terms(rounds, filings, docs).collect()}
    assert got == {(i, f, v, "0000000077:a12") for i in (1, 2) for f, v in (("liquidation_pref", "1.5"), ("pro_rata", "true"))}
