"""Identities: clip names, hashes, split hashing, content ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchgrid.functions.boxes import c

# Suffixes that are not part of a clip name, and the name patterns of image exports.
FILE_SUFFIX = r"(?i)\.(mp4|avi|mov|mkv|jsonl|json)$"
IMAGE_SUFFIX = r"(?i)\.(jpe?g|png|bmp|webp|txt)$"
EXPORT_SUFFIX = r"(?i)[_.](png|jpe?g|webp)\.rf\.[0-9a-f]+$"
FRAME_NAME = r"^(.+)_frame_([0-9]+)$"
SHORT_FRAME_NAME = r"^(.+)_f([0-9]+)$"
TRAILING_INDEX = r"^(.+)_([0-9]+)$"
UNSAFE_CHARS = r"[^A-Za-z0-9._-]+"


def file_name(path) -> Column:
    return F.element_at(F.split(c(path), "/"), -1)


def clip_stem(name) -> Column:
    return F.regexp_replace(file_name(name), FILE_SUFFIX, "")


def safe_clip_name(stem) -> Column:
    """Unsafe character runs become one underscore; an empty rest becomes ``clip``."""
    s = c(stem)
    cleaned = F.regexp_replace(F.regexp_replace(s, UNSAFE_CHARS, "_"), "_+", "_")
    cleaned = F.regexp_replace(cleaned, "^_+|_+$", "")
    safe = s.rlike(r"^[A-Za-z0-9._-]+$")
    return F.when(safe, s).when(cleaned == "", F.lit("clip")).otherwise(cleaned)


def canonical_clip_id(name, rules: Sequence[tuple[str, str]] = ()) -> Column:
    """Canonical clip id: the first rule that matches the whole name wins.

    A rule is ``(pattern, prefix)``; its last two groups are the kind and the number, giving
    ``<prefix>_<kind><number padded to 3>``. A pattern without groups maps to the bare prefix.
    """
    stem = clip_stem(name)
    out = None
    for pattern, prefix in rules:
        full = f"^(?:{pattern})$"
        groups = pattern.replace("(?:", "").count("(")
        if groups >= 2:
            number = F.regexp_extract(stem, full, groups)
            trimmed = F.regexp_replace(number, "^0+(?=[0-9])", "")
            padded = F.when(F.length(trimmed) < 3, F.lpad(trimmed, 3, "0")).otherwise(trimmed)
            value = F.concat(F.lit(f"{prefix}_"), F.regexp_extract(stem, full, groups - 1), padded)
        else:
            value = F.lit(prefix)
        hit = stem.rlike(full)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    safe = safe_clip_name(stem)
    return safe if out is None else out.otherwise(safe)


def image_stem_and_frame(name) -> tuple[Column, Column]:
    """``(stem, frame)`` of an exported image name; the frame is null when the name has none."""
    base = F.regexp_replace(file_name(name), IMAGE_SUFFIX, "")
    base = F.regexp_replace(base, EXPORT_SUFFIX, "")
    stem, frame = base, F.lit(None).cast("int")
    for pattern in (TRAILING_INDEX, SHORT_FRAME_NAME, FRAME_NAME):
        hit = base.rlike(pattern)
        stem = F.when(hit, F.regexp_extract(base, pattern, 1)).otherwise(stem)
        frame = F.when(hit, F.regexp_extract(base, pattern, 2).try_cast("int")).otherwise(frame)
    return stem, frame


def sha1_mod(key, modulus: int) -> Column:
    """``sha1(key)`` as a 160-bit number modulo 4, 5 or 10, exactly, from its hex digits.

    16 is 1 modulo 5, so the digit sum decides modulo 5; the last digit decides modulo 4 (and 2), and
    modulo 10 follows from both.
    """
    h = F.sha1(c(key).cast("string"))
    last = F.conv(F.substring(h, 40, 1), 16, 10).cast("int")
    if modulus == 4:
        return F.pmod(last, F.lit(4))
    digits = F.transform(F.split(h, ""), lambda d: F.conv(d, 16, 10).cast("int"))
    total = F.aggregate(F.filter(digits, lambda d: d.isNotNull()), F.lit(0), lambda a, d: a + d)
    if modulus == 5:
        return F.pmod(total, F.lit(5))
    if modulus == 10:
        five, two = F.pmod(total, F.lit(5)), F.pmod(last, F.lit(2))
        return F.when(F.pmod(five, F.lit(2)) == two, five).otherwise(five + 5)
    raise ValueError("modulus must be 4, 5 or 10")


def hash60(key) -> Column:
    """The first 60 bits of ``sha1(key)`` as a BIGINT."""
    return F.conv(F.substring(F.sha1(c(key).cast("string")), 1, 15), 16, 10).cast("long")


def hashed_uniform(key) -> Column:
    """A uniform number in (0, 1) that depends on the key only, so an order never reshuffles."""
    return (hash60(key) + F.lit(0.5)) / F.lit(float(1 << 60))


def content_id(frame, label, x, y, w, h, digits: int = 16) -> Column:
    """Content-addressed detection id: frame, label and the box on a 1e-6 grid."""

    def q(v) -> Column:
        return F.bround(c(v) * 1_000_000).cast("long").cast("string")

    text = F.concat_ws("|", c(frame).cast("string"), c(label), q(x), q(y), q(w), q(h))
    return F.substring(F.sha2(text, 256), 1, digits)


def content_id_long(hex16: Column) -> Column:
    """The 63-bit form: the first 16 hex digits shifted right by one."""
    head = F.conv(F.substring(hex16, 1, 15), 16, 10).cast("long")
    last = F.conv(F.substring(hex16, 16, 1), 16, 10).cast("long")
    return head * 8 + F.floor(last / 2).cast("long")


def window_id(match, frame, frames: int = 6000) -> Column:
    n = F.floor(c(frame) / F.lit(frames)).cast("string")
    padded = F.when(F.length(n) < 4, F.lpad(n, 4, "0")).otherwise(n)
    return F.concat(c(match), F.lit("_w"), padded)
