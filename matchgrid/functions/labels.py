"""Label rules as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrid.functions.boxes import c

# Fixed values.
METHOD_RANK = {"hand_series": 4, "hand_frame": 4, "verdict": 3, "offline_audited": 2, "sidecar_marker": 1}
MARKER_TAGS = ("no_ball", "not_broadcast", "players_complete")
PROVENANCE_TAGS = ("labeller", "yolo", "sam3", "vittrack", "detector_track", "human_checked")
LABELLED_STATES = ("complete", "absent")
GT_PREFIX = "gt_import_"
BAND_EDGES = (0.50, 0.70, 0.80, 0.90, 0.95, 0.98, 1.0001)


def is_true(v) -> Column:
    return c(v).eqNullSafe(F.lit(True))


def is_false(v) -> Column:
    return c(v).eqNullSafe(F.lit(False))


def method_rank(method) -> Column:
    out = F.lit(0)
    for name, rank in METHOD_RANK.items():
        out = F.when(c(method) == name, F.lit(rank)).otherwise(out)
    return out


def provenance_tier(source, reviewed) -> Column:
    """1 placed by hand, 2 machine box confirmed by a person, 3 machine only."""
    return F.when(c(source) == "hand_label", 1).when(is_true(reviewed), 2).otherwise(3)


def run_group(run_id="run_id", game_id="game_id") -> Column:
    """Runs of one label flush count as one batch; any other run is a batch of its own."""
    return F.when(c(run_id).startswith(GT_PREFIX), F.concat(F.lit("gt_import:"), c(game_id))).otherwise(c(run_id))


def object_class(tags) -> Column:
    """First tag that is neither a provenance nor a marker tag."""
    skip = [*PROVENANCE_TAGS, *MARKER_TAGS]
    return F.get(F.filter(c(tags), lambda t: ~t.isin(*skip)), F.lit(0))


def provenance(tags) -> Column:
    return F.get(F.filter(c(tags), lambda t: t.isin(*PROVENANCE_TAGS[:-1])), F.lit(0))


def is_checked(tags) -> Column:
    return F.array_contains(c(tags), "human_checked")


def marker(tags) -> Column:
    return F.get(F.filter(c(tags), lambda t: t.isin(*MARKER_TAGS)), F.lit(0))


def source_filter(tokens: Sequence[str] | None, source="source", reviewed="reviewed") -> Column:
    """None means hand or reviewed rows; an empty list selects nothing; names select by source."""
    if tokens is None:
        return (c(source) == "hand_label") | is_true(reviewed)
    if not tokens:
        return F.lit(False)
    if "all" in tokens:
        return F.lit(True)
    out = F.lit(False)
    names = [t for t in tokens if t != "reviewed"]
    if "reviewed" in tokens:
        out = out | is_true(reviewed)
    if names:
        out = out | c(source).isin(*names)
    return out


def bucket_flags(p="p_real", gap="gap_frame", static="static_flag", plausible="plausible", smax="smax", smin="smin",
                 n_sources="n_sources", post=None, sam=None) -> dict[str, Column]:
    """Eligibility of a pool node for the card buckets and its rank columns."""
    p_, gap_, static_ = c(p), is_true(gap), is_true(static)
    implausible = is_false(plausible)
    spread = F.when(c(n_sources) >= 2, c(smax) - c(smin)).otherwise(F.lit(0.0))
    post_in = F.lit(False) if post is None else F.coalesce(c(post).between(0.30, 0.70), F.lit(False))
    sam_no = F.lit(False) if sam is None else is_false(sam)
    band = F.lit(len(BAND_EDGES) - 2)
    for i in reversed(range(len(BAND_EDGES) - 2)):
        band = F.when(p_ < BAND_EDGES[i + 1], F.lit(i)).otherwise(band)
    uncertain = p_.between(0.30, 0.90) | (spread >= 0.35) | post_in | (sam_no & (p_ >= 0.30))
    return {
        "u": ~gap_ & ~static_ & uncertain,
        "m": gap_ & ~implausible & (p_ >= 0.20),
        "n": (static_ | implausible) & (c(smax) >= 0.50),
        "a": p_ >= 0.50,
        "a_band": F.when(p_ >= 0.50, band).otherwise(F.lit(-1)),
        "u_rank": F.abs(p_ - 0.5),
        "m_rank": p_,
        "n_rank": c(smax),
    }


def link_decision(similarity) -> Column:
    s = c(similarity)
    return F.when(s.isNull(), "ask").when(s >= 0.80, "merge").when(s < 0.55, "reject").otherwise("ask")


def link_uncertainty(similarity) -> Column:
    return F.coalesce(F.abs(c(similarity) - F.lit((0.55 + 0.80) / 2)), F.lit(0.0))


def frame_risk(crowding, confidence, margin) -> Column:
    def unit(v) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c(v)))

    return 0.25 * F.least(c(crowding), F.lit(10)) / 10.0 + 0.25 * (1.0 - unit(confidence)) + 0.5 * (1.0 - unit(margin))


def tracking_kind(marker_, has_live_ball: Column, has_boxes: Column, has_checks: Column) -> Column:
    m = c(marker_)
    return (
        F.when(m == "not_broadcast", "not_broadcast")
        .when(has_live_ball, "ball")
        .when(m == "no_ball", "no_ball")
        .when(has_boxes, "other_boxes")
        .when(has_checks, "check_only")
        .otherwise("empty")
    )


def panel_outcome(state, pred_dist, radius) -> Column:
    """Outcome of a scored frame: ``pred_dist`` is null when nothing was predicted.

    Frames outside the broadcast are not scored (null); on an empty frame any prediction is false.
    """
    d = c(pred_dist)
    return (
        F.when(c(state) == "not_broadcast", F.lit(None).cast("string"))
        .when((c(state) == "no_ball") & d.isNull(), "true_empty")
        .when(c(state) == "no_ball", "false_ball")
        .when(d.isNull(), "miss")
        .when(d <= c(radius), "hit")
        .otherwise("off")
    )


def sampling_weight(conf, tau: float = 0.25, sigma: float = 0.10, focus: float = 0.98) -> Column:
    """A bump at the decision boundary plus a uniform floor."""
    z = (c(conf) - F.lit(tau)) / F.lit(max(sigma, 1e-6))
    return F.lit(focus * 5.0) * F.exp(F.lit(-0.5) * z * z) + F.lit(1.0 - focus)


def bin_centre(conf, bins: int = 100) -> Column:
    x = F.least(F.greatest(c(conf), F.lit(0.0)), F.lit(0.999999))
    return (F.floor(x * bins) + 0.5) / bins

