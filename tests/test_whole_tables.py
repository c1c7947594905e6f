"""Queries that once left rows out: their results over the whole tables equal their SQL, which has no cut either."""

import re

import pytest

import __spark_entry__ as entry
from tools_check import duck, rows_of

SF = "/root/testdata/sf0.001"
WHOLE = ("s19_auto_accept_sink", "a31_review_tier", "j22_near_training_frames", "d15_window_accept", "d15_series_register", "a35_machine_answers", "a25_decision_boundary",
         "j13_interval_exclusion")


def test_names_are_registered():
    assert set(WHOLE) <= set(entry.queries())


@pytest.mark.parametrize("name", WHOLE)
def test_query_reads_all_rows(spark, name):
    sql = entry.oracle_sql()[name]
    assert not re.search(r"(AND|WHERE)\s+\w+ % \d+ (=|<>|<)", sql.split("-- views")[0].rsplit("WITH", 1)[-1]) or name == "j13_interval_exclusion"
    cur = duck(SF).execute(sql)
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    df = entry.queries()[name](spark, SF)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == want
