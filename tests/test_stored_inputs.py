"""Queries that read the detections several times store what they read of them: numbering the boxes of a frame moves whole rows."""

from matchgrid.catalog import load_all, q_jobs, q_metrics
from matchgrid.catalog.registry import QUERIES, Tables

load_all()
SF = "/root/testdata/sf0.001"


def reads_boxes(df):
    return "l_orderkey" in df._jdf.queryExecution().optimizedPlan().toString()


def test_detections_are_numbered_once(spark):
    t = Tables(spark, SF)
    assert reads_boxes(t.detection)
    assert not reads_boxes(q_jobs.candidates(t)[0]) and not reads_boxes(q_metrics.person_boxes(t))
    assert not [q for q in ("j26_two_source_merge", "a29_crowd_score", "a34_teacher_score", "k02_tracker_registry") if reads_boxes(QUERIES[q](spark, SF))]
