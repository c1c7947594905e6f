"""The append-only label log: numbers, torn lines, supersession."""

import tempfile

from matchgrid.sources import label_log

ROW = "pair string, verdict string, ts long"


def test_appends_are_numbered_and_torn_lines_are_left_out(spark):
    folder = tempfile.mkdtemp(prefix="log-") + "/log"
    first = [("a-b", "same", 1), ("a-c", "different", 2), ("b-c", "same", 3)]
    label_log.append(spark.createDataFrame(first, ROW), folder, "007", ["ts"])
    assert label_log.last_number(spark, folder, "007") == 3
    label_log.append(spark.createDataFrame([("a-b", "unsure", 1)], ROW), folder, "w2", ["ts"])
    # A crash in the middle of a line, a blank line and text that is no record.
    whole = label_log.lines(spark.createDataFrame([("a-c", "same", 9), ("d-e", "same", 10)], ROW), ["ts"], 3).collect()
    label_log.append_lines(spark.createDataFrame([(whole[0][0],), (whole[1][0][:-9],), ("",), ("[1]",)], "value string"), folder, "007")
    # The torn number is given again; a null verdict takes a label back, a row written twice counts once.
    label_log.append(spark.createDataFrame([("b-c", None, 11), ("é \"q\"", "same", 12)], ROW), folder, "007", ["ts"])
    log = label_log.read(spark, folder, ROW)
    got = {r["pair"]: (r["verdict"], r["writer"], r["seq"]) for r in label_log.live(log.unionByName(log), ["pair"], "verdict").collect()}
    assert got == {"a-b": ("unsure", "w2", 1), "a-c": ("same", "007", 4), "é \"q\"": ("same", "007", 6)}
    state = {r["writer"]: tuple(r)[1:] for r in label_log.health(log).collect()}
    assert state == {"007": (8, 2, 0), "w2": (1, 0, 0)}


def test_a_lost_line_shows_as_a_missing_number(spark):
    folder = tempfile.mkdtemp(prefix="log-") + "/log"
    kept = [r for i, r in enumerate(label_log.lines(spark.createDataFrame([(f"p{i}", "same", i) for i in range(20)], ROW), ["ts"]).collect()) if i not in (4, 7)]
    label_log.append_lines(spark.createDataFrame(kept, "value string"), folder, "w")
    assert label_log.health(label_log.read(spark, folder, ROW)).first()["n_missing"] == 2
