"""Queries over whole tables leave out no id."""

import os

import pytest

from granary import catalog
from granary.queries.base import Tables

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are absent")


def test_every_id_has_a_result(spark):
    t, q = Tables(spark, SF), catalog.queries()
    ids = lambda df, c: {r[0] for r in df.select(c).collect()}
    run = lambda name: q[name](spark, SF)
    assert ids(run("tt1_round_facts"), "round_id") == ids(t.rounds, "round_id")
    assert ids(run("lb5_progress_labels"), "round_id") == ids(t.rounds.where("add_months(round_date, 18) <= '1998-06-01'"), "round_id")
    assert len({i % 5 for i in ids(run("tt3_narrative_terms"), "round_id")}) == 5
    assert ids(run("er8_matched_pairs"), "company_id") == ids(t.companies, "company_id")
    assert {r["items"] for r in run("pl4_run_summary").collect()} == {t.deals.count()}
    assert {r["n"] for r in run("ag21_run_agreement").collect()} == {t.deals.count()}
