"""A spread of registered queries against their SQL on the smallest tables (all of them: ``tools_check.py``)."""

import pytest

import __spark_entry__ as entry
from tools_check import duck, rows_of

SF = "/root/testdata/sf0.001"
NAMES = (
    "j01_frame_features w01_batch_rank j02_detections_enriched w02_best_calibration j04_detections_on_pitch a01_source_overlap "
    "a04_label_coverage w04_latest_verdicts w05_latest_pair_labels w06_smooth_mask w07_run_length w10_rolling_outlier "
    "w11_gap_interpolate w19_timeline_tiles w27_merge_passes d01_keyed_upsert d02_precedence_upsert d12_constraint_report "
    "p15_canonical_clip_id p17_split_of u02_ball_states j07_crowded_boxes j08_best_iou_match j09_greedy_match j10_gap_bridging_links "
    "j11_nearest_evidence j13_interval_exclusion j16_nearest_mark j19_snapshot_diff a08_average_precision a12_panel_bootstrap "
    "a18_threshold_walk a30_identity_clusters a38_content_hash t07_exponential_race t11_probability_sample x08_stream_latest_verdicts"
).split()


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = duck(SF).execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert got == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 180


def test_entry_runs(spark):
    assert entry.entry(spark).limit(5).count() == 5
