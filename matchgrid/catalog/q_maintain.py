"""Table maintenance, set operations and splits."""

from pyspark.sql import functions as F

from matchgrid.catalog.q_store import WON
from matchgrid.catalog.registry import query
from matchgrid.functions import ids
from matchgrid.functions.boxes import PLAYER_LABELS, is_ball
from matchgrid.operators import maintain, sets, splits, store
from matchgrid.operators.windows import first_version

RANK = "CASE method WHEN 'hand_series' THEN 4 WHEN 'hand_frame' THEN 4 WHEN 'verdict' THEN 3 WHEN 'offline_audited' THEN 2 ELSE 1 END"
KEYS = ["game_id", "frame_index", "cls_group"]
COLS = "game_id, frame_index, cls_group, state, method"


@query("d01_keyed_upsert", f"""
WITH lastb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, frame_index, cls_group ORDER BY seq DESC) AS rn FROM state_batch) WHERE rn = 1)
SELECT {COLS} FROM frame_label_state b WHERE NOT EXISTS (SELECT 1 FROM lastb l WHERE l.game_id = b.game_id AND l.frame_index = b.frame_index AND l.cls_group = b.cls_group)
UNION ALL SELECT {COLS} FROM lastb""")
def _(t):
    base = t.frame_label_state.select(*KEYS, "state", "method")
    return maintain.upsert(base, t.state_batch, KEYS, "seq").select(*KEYS, "state", "method")


@query("d02_precedence_upsert", f"""
WITH u AS (SELECT {COLS}, -1 AS seq FROM frame_label_state UNION ALL SELECT {COLS}, seq FROM state_batch)
SELECT {COLS} FROM (SELECT *, row_number() OVER (PARTITION BY game_id, frame_index, cls_group ORDER BY {RANK} DESC, seq DESC) AS rn FROM u) WHERE rn = 1""")
def _(t):
    return maintain.upsert_label_states(t.frame_label_state.select(*KEYS, "state", "method"), t.state_batch)


@query("d03_delete_run_rows", """
SELECT count_if(starts_with(run_id, 'gt_import_'))::BIGINT AS deleted, count_if(NOT starts_with(run_id, 'gt_import_'))::BIGINT AS kept FROM detection""")
def _(t):
    return maintain.delete_run_rows(t.detection, "gt_import_")[1]


@query("d04_delete_calibration_rows", "SELECT game_id, frame_index, source, run_id FROM calibration WHERE NOT source = 'classical'")
def _(t):
    return maintain.delete_where(t.calibration, F.col("source") == "classical")[0].select("game_id", "frame_index", "source", "run_id")


@query("d05_delete_states_of_method", f"SELECT {COLS} FROM frame_label_state WHERE method <> 'verdict'")
def _(t):
    return maintain.delete_states_of_method(t.frame_label_state, "verdict")[0].select(*KEYS, "state", "method")


@query("d06_replace_per_clip", """
WITH base AS (SELECT game_id AS clip, frame_index, label FROM detection WHERE source = 'hand_label'),
parsed AS (SELECT game_id AS clip, frame_index, label FROM detection WHERE source = 'yolo' AND track_id IS NOT NULL),
rep AS (SELECT game_id AS clip, count_if(track_id IS NOT NULL AND CAST(substr(game_id, 2) AS INT) % 3 <> 0)::BIGINT AS n_valid, count(*) AS n_skipped FROM detection WHERE source = 'yolo' GROUP BY ALL),
ok AS (SELECT clip FROM rep WHERE NOT (n_valid = 0 AND n_skipped > 0))
SELECT clip, frame_index, label FROM base WHERE clip NOT IN (SELECT clip FROM ok)
UNION ALL SELECT clip, frame_index, label FROM parsed WHERE clip IN (SELECT clip FROM ok)""")
def _(t):
    d = t.detection.withColumnRenamed("game_id", "clip")
    y = d.where("source = 'yolo'")
    bad = F.substring("clip", 2, 9).cast("int") % 3 != 0
    rep = y.groupBy("clip").agg(F.count_if(F.col("track_id").isNotNull() & bad).alias("n_valid"), F.count("*").alias("n_skipped"))
    base = d.where("source = 'hand_label'").select("clip", "frame_index", "label")
    return maintain.replace_per_clip(base, y.where("track_id IS NOT NULL").select("clip", "frame_index", "label"), rep)


@query("d07_set_flag", """
SELECT d.game_id, d.frame_index, d.detection_id, CASE WHEN run_id = 'yolo_r1' THEN coalesce(confidence < 0.4, false) ELSE reviewed END AS needs_review FROM detection d""")
def _(t):
    k = ["game_id", "frame_index", "detection_id"]
    d = t.detection.select(*k, "run_id", "confidence", F.col("reviewed").alias("needs_review"))
    return maintain.set_flag(d, d.where("confidence < 0.4"), k, F.col("run_id") == "yolo_r1", "needs_review").select(*k, "needs_review")


@query("d08_tag_exported", """
SELECT d.game_id, d.frame_index, d.detection_id, coalesce('export_v1:' || i.split, d.source) AS dataset_tag FROM detection d
LEFT JOIN (SELECT clip AS game_id, frame_index, split FROM item WHERE tier = 1) i USING (game_id, frame_index)""")
def _(t):
    d = t.detection.select("game_id", "frame_index", "detection_id", F.col("source").alias("dataset_tag"))
    e = t.item.where("tier = 1").select(F.col("clip").alias("game_id"), "frame_index", "split")
    return maintain.tag_rows(d, e, ["game_id", "frame_index"], "export_v1")


@query("d09_replace_index_rows", f"""
WITH lastb AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id, cls_group ORDER BY frame_index DESC, seq DESC) AS rn FROM state_batch) WHERE rn = 1)
SELECT game_id, cls_group, state FROM lastb""")
def _(t):
    b = t.state_batch.withColumn("ord", F.struct("frame_index", "seq"))
    base = b.limit(0).select("game_id", "cls_group", "state")
    return maintain.upsert(base, b.select("game_id", "cls_group", "state", "ord"), ["game_id", "cls_group"], "ord").select("game_id", "cls_group", "state")


# Rules of the sample names: a pattern for the whole stem and the canonical prefix.
CLIP_RULES = (
    (r"(?:north_)?east_(?:2025[0-9]{4}_)?(seg|part)([0-9]+)", "north_east"),
    (r"(?:North vs West 1|(?:north_)?west_1st)_(seg)([0-9]+)", "north_west_1st"),
)
STEM = "regexp_replace(regexp_extract(name, '[^/]+$'), '\\.(mp4|avi|mov|mkv|jsonl|json)$', '')"
CID = f"""
nm AS (SELECT *, {STEM} AS stem FROM clip_name),
ci AS (SELECT *, CASE
  WHEN regexp_full_match(stem, '(?:north_)?east_(?:2025[0-9]{{4}}_)?(seg|part)([0-9]+)') THEN concat('north_east_', regexp_extract(stem, '(seg|part)([0-9]+)$', 1), printf('%03d', CAST(regexp_extract(stem, '(seg|part)([0-9]+)$', 2) AS INT)))
  WHEN regexp_full_match(stem, '(?:North vs West 1|(?:north_)?west_1st)_(seg)([0-9]+)') THEN concat('north_west_1st_seg', printf('%03d', CAST(regexp_extract(stem, 'seg([0-9]+)$', 1) AS INT)))
  WHEN regexp_full_match(stem, '[A-Za-z0-9._-]+') THEN stem
  ELSE regexp_replace(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '^_+|_+$', '', 'g') END AS cid FROM nm)"""


def canonical(t):
    return t.clip_name.withColumn("stem", ids.clip_stem("name")).withColumn("cid", ids.canonical_clip_id("name", CLIP_RULES))


@query("p15_canonical_clip_id", f"WITH {CID} SELECT name_id, stem, cid FROM ci")
def _(t):
    return canonical(t).select("name_id", "stem", "cid")


@query("a47_alias_groups", f"""
WITH {CID} SELECT cid, string_agg(DISTINCT stem, ',' ORDER BY stem) AS stems, count(DISTINCT stem) AS n FROM ci GROUP BY cid HAVING count(DISTINCT stem) > 1""")
def _(t):
    d = canonical(t).select("cid", "stem").distinct()
    return d.groupBy("cid").agg(F.concat_ws(",", F.sort_array(F.collect_list("stem"))).alias("stems"), F.count("*").alias("n")).where("n > 1")


@query("d10_alias_fan_out", f"""
WITH {CID}, games AS (SELECT DISTINCT cid, stem AS game_id FROM ci WHERE name_id % 2 = 0)
SELECT f.name_id, f.cid, coalesce(g.game_id, f.cid) AS game_id FROM (SELECT name_id, cid FROM ci WHERE name_id % 2 = 1) f LEFT JOIN games g USING (cid)""")
def _(t):
    c = canonical(t)
    games = c.where("name_id % 2 = 0").select("cid", F.col("stem").alias("game_id"))
    return maintain.alias_fan_out(c.where("name_id % 2 = 1").select("name_id", "cid"), games).select("name_id", "cid", "game_id")


IMG = r"""
b0 AS (SELECT name_id, image, split_part(image, '/', 1) AS subset, regexp_replace(regexp_replace(regexp_extract(image, '[^/]+$'), '(?i)\.(jpe?g|png|bmp|webp|txt)$', ''), '(?i)[_.](png|jpe?g|webp)\.rf\.[0-9a-f]+$', '') AS base FROM clip_name),
im AS (SELECT *, CASE WHEN regexp_matches(base, '^(.+)_frame_([0-9]+)$') THEN regexp_extract(base, '^(.+)_frame_([0-9]+)$', 1)
   WHEN regexp_matches(base, '^(.+)_f([0-9]+)$') THEN regexp_extract(base, '^(.+)_f([0-9]+)$', 1)
   WHEN regexp_matches(base, '^(.+)_([0-9]+)$') THEN regexp_extract(base, '^(.+)_([0-9]+)$', 1) ELSE base END AS stem,
   TRY_CAST(CASE WHEN regexp_matches(base, '^(.+)_f(?:rame_)?([0-9]+)$') THEN regexp_extract(base, '_f(?:rame_)?([0-9]+)$', 1)
   WHEN regexp_matches(base, '^(.+)_([0-9]+)$') THEN regexp_extract(base, '_([0-9]+)$', 1) END AS INT) AS frame FROM b0)"""


def images(t):
    stem, frame = ids.image_stem_and_frame("image")
    return t.clip_name.select("name_id", "image", F.split_part("image", F.lit("/"), F.lit(1)).alias("subset"),
                              stem.alias("stem"), frame.alias("frame"))


@query("p14_image_name", f"WITH {IMG} SELECT name_id, stem, frame, subset FROM im")
def _(t):
    return images(t).select("name_id", "stem", "frame", "subset")


ALIASES = [("north_east", "east_2025"), ("east", "east_2025"), ("north_west_1st", "west_2025"), ("north", "north_other"), ("plain", "plain_m")]
ALIAS_SQL = "al AS (SELECT * FROM (VALUES ('north_east', 'east_2025'), ('east', 'east_2025'), ('north_west_1st', 'west_2025'), ('north', 'north_other'), ('plain', 'plain_m')) v(alias, match_key))"
MK = "mk AS (SELECT cid, arg_max(match_key, length(alias)) AS match_key FROM (SELECT DISTINCT cid FROM ci) c JOIN al ON c.cid = al.alias OR starts_with(c.cid, al.alias || '_') GROUP BY cid)"


def aliases(t):
    return t.spark.createDataFrame(ALIASES, "alias string, match_key string")


@query("p16_match_key", f"WITH {CID}, {ALIAS_SQL}, {MK} SELECT ci.name_id, ci.cid, mk.match_key FROM ci LEFT JOIN mk USING (cid)")
def _(t):
    return splits.match_of(canonical(t), "cid", aliases(t)).select("name_id", "cid", "match_key")


DIGITS = "list_sum(list_transform(string_split(sha1({k}), ''), lambda x: CASE WHEN x = '' THEN 0 ELSE CAST('0x' || x AS INT) END))"
SPLIT_SQL = f"""
mr AS (SELECT 'east_2025' AS match_key, 'train' AS split UNION ALL SELECT 'west_2025', 'heldout'),
cr AS (SELECT 'north_east_seg004' AS clip, 'eval' AS split UNION ALL SELECT 'north_east_seg005', 'train'),
sp AS (SELECT ci.name_id, ci.cid, mk.match_key, CASE WHEN mr.split = 'heldout' THEN 'eval_heldout_match' WHEN cr.split = 'eval' THEN 'eval_in_match' WHEN cr.split IS NOT NULL THEN 'train'
   WHEN CAST({DIGITS.format(k='ci.cid')} AS BIGINT) % 5 = 0 THEN 'eval_in_match' ELSE 'train' END AS split
   FROM ci LEFT JOIN mk USING (cid) LEFT JOIN mr USING (match_key) LEFT JOIN cr ON cr.clip = ci.cid)"""


def registers(t):
    m = t.spark.createDataFrame([("east_2025", "train"), ("west_2025", "heldout")], "match_key string, split string")
    c = t.spark.createDataFrame([("north_east_seg004", "eval"), ("north_east_seg005", "train")], "clip string, split string")
    return m, c


@query("p17_split_of", f"WITH {CID}, {ALIAS_SQL}, {MK}, {SPLIT_SQL} SELECT name_id, cid, split FROM sp")
def _(t):
    m, c = registers(t)
    d = splits.match_of(canonical(t), "cid", aliases(t))
    return splits.assign_split(d, "match_key", "cid", m, c.withColumnRenamed("clip", "clip")).select("name_id", "cid", "split")


@query("p17_match_rule", """
SELECT DISTINCT game_id, CASE WHEN CAST('0x' || right(sha1(game_id || ':' || run_id), 1) AS INT) % 4 = 0 THEN 'heldout' ELSE 'train' END AS split, run_id FROM detection""")
def _(t):
    d = t.detection.select("game_id", "run_id").distinct()
    return d.withColumn("split", splits.default_match_split(F.concat("game_id", F.lit(":"), "run_id")))


@query("j21_contamination_scan", f"""
WITH {IMG.replace('clip_name', 'clip_name')}, {ALIAS_SQL},
ci AS (SELECT *, stem AS cid FROM im), {MK}, {SPLIT_SQL.replace('SELECT ci.name_id', 'SELECT ci.name_id, ci.subset, ci.image')},
ct AS (SELECT subset, split, count(*) AS n, count(DISTINCT cid) AS clips FROM sp GROUP BY ALL),
ex AS (SELECT subset, split, string_agg(image, ',' ORDER BY image) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY subset, split ORDER BY image) AS rn
   FROM (SELECT DISTINCT subset, split, image FROM sp)) WHERE rn <= 5 GROUP BY ALL)
SELECT ct.subset, ct.split, n, clips, examples FROM ct JOIN ex USING (subset, split)""")
def _(t):
    m, c = registers(t)
    d = splits.match_of(images(t).withColumnRenamed("stem", "clip").withColumnRenamed("image", "name"), "clip", aliases(t))
    return splits.contamination(splits.assign_split(d, "match_key", "clip", m, c), examples=5)


FP = """SELECT count(*) AS n, sum(hi) % 2147483647 AS hi, sum(lo) % 2147483647 AS lo FROM (
 SELECT CAST('0x' || substr(h, 1, 6) AS BIGINT) AS hi, CAST('0x' || substr(h, 7, 6) AS BIGINT) AS lo FROM (
 SELECT sha256(concat_ws('|', game_id, frame_index, detection_id, label, coalesce(CAST(track_id AS STRING), '~'))) AS h FROM detection))"""


@query("d11_table_fingerprint", f"SELECT n, CAST(hi AS BIGINT) AS hi, CAST(lo AS BIGINT) AS lo FROM ({FP})")
def _(t):
    return maintain.fingerprint(t.detection, ["game_id", "frame_index", "detection_id", "label", "track_id"])


@query("d12_constraint_report", """
SELECT unnest(['bbox_in_unit', 'confidence_present', 'label_known', 'track_non_negative']) AS rule,
 unnest([count_if(NOT (bbox_x >= 0 AND bbox_y >= 0 AND bbox_x + bbox_w <= 1 AND bbox_y + bbox_h <= 1)), count_if(NOT coalesce(confidence BETWEEN 0 AND 1, false)),
  count_if(label NOT IN ('player', 'in_play_ball')), count_if(NOT coalesce(track_id >= 0, false))])::BIGINT AS violations FROM detection""")
def _(t):
    b = [F.col(f"bbox_{c}") for c in "xywh"]
    return maintain.constraint_report(t.detection, {
        "bbox_in_unit": (b[0] >= 0) & (b[1] >= 0) & (b[0] + b[2] <= 1) & (b[1] + b[3] <= 1),
        "confidence_present": F.col("confidence").between(0, 1),
        "label_known": F.col("label").isin("player", "in_play_ball"),
        "track_non_negative": F.col("track_id") >= 0})


@query("d14_backfill_named_clips", """
WITH marked AS (SELECT game_id, frame_index FROM frame_label_state WHERE cls_group = 'player' AND method = 'sidecar_marker'),
cand AS (SELECT DISTINCT game_id, frame_index FROM detection WHERE source = 'hand_label' AND label <> 'in_play_ball')
SELECT game_id, frame_index, 'marker' AS origin FROM marked
UNION ALL SELECT game_id, frame_index, 'backfill' FROM cand c WHERE game_id IN (SELECT game_id FROM game WHERE match_bucket = 1)
 AND NOT EXISTS (SELECT 1 FROM marked m WHERE m.game_id = c.game_id AND m.frame_index = c.frame_index)""")
def _(t):
    k = ["game_id", "frame_index"]
    marked = t.frame_label_state.where("cls_group = 'player' AND method = 'sidecar_marker'").select(*k, F.lit("marker").alias("origin"))
    cand = t.detection.where("source = 'hand_label' AND label <> 'in_play_ball'").select(*k).distinct().withColumn("origin", F.lit("backfill"))
    return maintain.backfill(marked, cand, t.game.where("match_bucket = 1"), "game_id", k)


WINDOW_EX = """
fr AS (SELECT concat(game_id, '_f', (frame_index // 25) * 25) AS window_id, frame_index FROM frame),
ex AS (SELECT DISTINCT concat(game_id, '_f', (frame_index // 25) * 25) AS window_id, frame_index,
   CASE WHEN confidence < 0.05 THEN 'no_ball' WHEN confidence < 0.12 THEN 'wrong_ball' ELSE 'players' END AS kind FROM detection WHERE confidence < 0.15),
e1 AS (SELECT window_id, frame_index, bool_or(kind = 'no_ball') AS nb, bool_or(kind = 'wrong_ball') AS wb, bool_or(kind = 'players') AS pl FROM ex GROUP BY ALL),
d AS (SELECT fr.*, coalesce(nb, false) AS nb, coalesce(wb, false) AS wb, coalesce(pl, false) AS pl FROM fr LEFT JOIN e1 USING (window_id, frame_index)),
st AS (SELECT window_id, count(*) AS n, count_if(nb OR wb OR pl)::BIGINT AS n_exceptions FROM d GROUP BY ALL),
s AS (SELECT d.*, CASE WHEN nb THEN 'absent' WHEN wb THEN 'unreviewed' ELSE 'complete' END AS ball_state, CASE WHEN pl THEN 'partial' ELSE 'complete' END AS player_state
  FROM d JOIN st USING (window_id) WHERE n_exceptions <= n * 0.1)"""


def window_parts(t):
    wid = F.concat("game_id", F.lit("_f"), F.floor(F.col("frame_index") / 25) * 25)
    fr = t.frame.select(wid.alias("window_id"), "frame_index")
    kind = F.when(F.col("confidence") < 0.05, "no_ball").when(F.col("confidence") < 0.12, "wrong_ball").otherwise("players")
    ex = t.detection.where("confidence < 0.15").select(wid.alias("window_id"), "frame_index", kind.alias("kind"))
    return maintain.accept_window(fr, ex)


@query("d15_window_accept", f"WITH {WINDOW_EX} SELECT window_id, frame_index, ball_state, player_state FROM s")
def _(t):
    return window_parts(t)["states"].select("window_id", "frame_index", "ball_state", "player_state")


@query("d15_series_register", f"""
WITH {WINDOW_EX} SELECT window_id, min(frame_index) AS "start", max(frame_index) AS "end", count(*) AS n FROM s GROUP BY window_id
HAVING bool_and(ball_state IN ('complete', 'absent') AND player_state = 'complete') AND count(*) = max(frame_index) - min(frame_index) + 1""")
def _(t):
    return window_parts(t)["series"]


@query("d16_frame_markers", """
SELECT game_id, frame_index, CASE max(CASE WHEN state = 'unreviewed' THEN 2 WHEN state = 'absent' THEN 1 ELSE 0 END) WHEN 2 THEN 'not_broadcast' WHEN 1 THEN 'no_ball' END AS marker
FROM frame_label_state GROUP BY game_id, frame_index""")
def _(t):
    m = F.when(F.col("state") == "unreviewed", "not_broadcast").when(F.col("state") == "absent", "no_ball")
    return maintain.frame_markers(t.frame_label_state.withColumn("marker", m), ["game_id", "frame_index"])


@query("d13_dataset_bump", """
WITH parent AS (SELECT item_id, sha256(concat_ws('|', item_id, split, label_kind)) AS h, frame_index % 3 + 1 AS first_version FROM item WHERE frame_index % 7 <> 0),
cur AS (SELECT item_id, split, sha256(concat_ws('|', item_id, split, CASE WHEN tier = 3 AND frame_index % 2 = 0 THEN 'ball' ELSE label_kind END)) AS h FROM item WHERE frame_index % 11 <> 0)
SELECT coalesce(c.item_id, p.item_id) AS item_id, CASE WHEN p.item_id IS NULL THEN 'added' WHEN c.item_id IS NULL THEN 'removed' WHEN c.h <> p.h THEN 'changed' ELSE 'same' END AS change,
 CASE WHEN c.item_id IS NOT NULL THEN coalesce(p.first_version, 4) END AS first_version FROM cur c FULL JOIN parent p USING (item_id)""")
def _(t):
    from matchgrid.operators.snapshots import diff_items, item_hash

    parent = item_hash(t.item.where("frame_index % 7 <> 0"), ["item_id", "split", "label_kind"]).withColumn(
        "first_version", F.col("frame_index") % 3 + 1)
    cur = t.item.where("frame_index % 11 <> 0").withColumn(
        "label_kind", F.when((F.col("tier") == 3) & (F.col("frame_index") % 2 == 0), "ball").otherwise(F.col("label_kind")))
    cur = item_hash(cur, ["item_id", "split", "label_kind"])
    d = diff_items(cur, parent, keep_same=True).select("item_id", "change")
    fv = first_version(cur.select("item_id"), parent, 4)
    return d.join(fv, "item_id", "left").select("item_id", "change", "first_version")


@query("u01_first_source_wins", """
WITH a AS (SELECT game_id, frame_index, label, 0 AS r FROM detection WHERE source = 'hand_label' AND CAST(substr(game_id, 2) AS INT) % 2 = 0),
b AS (SELECT game_id, frame_index, label, 1 AS r FROM detection WHERE source = 'yolo' AND CAST(substr(game_id, 2) AS INT) % 3 <> 1),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), f AS (SELECT game_id, min(r) AS w FROM u GROUP BY ALL)
SELECT u.game_id, frame_index, label, r AS source_rank FROM u JOIN f USING (game_id) WHERE r = w""")
def _(t):
    n = F.substring("game_id", 2, 9).cast("int")
    d = t.detection
    a = d.where((F.col("source") == "hand_label") & (n % 2 == 0)).select("game_id", "frame_index", "label")
    b = d.where((F.col("source") == "yolo") & (n % 3 != 1)).select("game_id", "frame_index", "label")
    return sets.first_source_wins([a, b], "game_id")[0]


@query("u02_ball_states", """
WITH a AS (SELECT DISTINCT game_id, frame_index FROM frame_label_state WHERE cls_group = 'ball' AND state = 'absent'),
b AS (SELECT DISTINCT game_id, frame_index FROM detection WHERE source = 'hand_label' AND label = 'in_play_ball')
SELECT game_id, frame_index, 'conflict' AS state FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT game_id, frame_index, 'absent' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)
UNION ALL SELECT game_id, frame_index, 'complete' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def _(t):
    a = t.frame_label_state.where("cls_group = 'ball' AND state = 'absent'")
    return sets.ball_states(a, t.detection.where((F.col("source") == "hand_label") & is_ball()), ["game_id", "frame_index"])


@query("u03_player_states", """
WITH m AS (SELECT DISTINCT game_id, frame_index FROM frame_label_state WHERE cls_group = 'player' AND method = 'hand_frame'),
b AS (SELECT DISTINCT game_id, frame_index FROM detection WHERE label IN ('player', 'referee'))
SELECT game_id, frame_index, 'complete' AS state FROM (SELECT * FROM m INTERSECT SELECT * FROM b)
UNION ALL SELECT game_id, frame_index, 'absent' FROM (SELECT * FROM m EXCEPT SELECT * FROM b)""")
def _(t):
    m = t.frame_label_state.where("cls_group = 'player' AND method = 'hand_frame'")
    return sets.player_states(m, t.detection.where(F.col("label").isin("player", "referee")), ["game_id", "frame_index"])


@query("u04_union_game_ids", "SELECT game_id FROM game UNION SELECT game_id FROM detection UNION SELECT game_id FROM verdict_log")
def _(t):
    return sets.union_ids([t.game, t.detection, t.verdict_log], "game_id")


CANON = WON + ", cn AS (SELECT * FROM marked WHERE canonical)"


def canonical_rows(t):
    from matchgrid.functions.labels import run_group

    best = store.winning_group(t.detection).withColumnRenamed("win_group", "run_group")
    return t.detection.withColumn("run_group", run_group()).join(best, ["game_id", "frame_index", "run_group"], "left_semi")


@query("u05_stateless_frames", f"""
WITH {CANON} SELECT game_id, frame_index FROM cn WHERE label IN ('player', 'player_sub', 'referee', 'coach', 'person') EXCEPT SELECT game_id, frame_index FROM frame_label_state WHERE cls_group = 'player'""")
def _(t):
    c = canonical_rows(t).where(F.col("label").isin(*PLAYER_LABELS))
    return sets.stateless_frames(c, t.frame_label_state.where("cls_group = 'player'"), ["game_id", "frame_index"])


@query("u05_export_frame_sets", f"""
WITH {CANON} SELECT game_id, frame_index, bool_or(label = 'player') AS has_requested, bool_or(label = 'referee') AS has_unrequested,
  bool_or(label NOT IN ('player', 'referee')) AS has_out_of_scope FROM cn GROUP BY ALL""")
def _(t):
    return sets.export_frame_sets(canonical_rows(t), ["player"], ["player", "referee"], ["game_id", "frame_index"])


@query("u06_scored_frames", """
WITH b AS (SELECT DISTINCT clip AS game_id, frame_index FROM ball_mark),
nb AS (SELECT DISTINCT game_id, frame_index FROM frame_label_state WHERE cls_group = 'ball' AND state = 'absent'),
off_ AS (SELECT game_id, frame_index FROM frame WHERE is_broadcast = false)
SELECT game_id, frame_index, 'ball' AS kind FROM b UNION ALL
SELECT game_id, frame_index, 'no_ball' FROM (SELECT * FROM nb EXCEPT SELECT * FROM b EXCEPT SELECT * FROM off_)""")
def _(t):
    m = t.ball_mark.withColumnRenamed("clip", "game_id")
    nb = t.frame_label_state.where("cls_group = 'ball' AND state = 'absent'")
    return sets.scored_frames(m, nb, t.frame.where("is_broadcast = false"), ["game_id", "frame_index"])
