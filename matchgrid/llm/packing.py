"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are powers of two: as many of the longest length as fit, then
the binary digits of the rest. Each piece is a sequence of its own, and sequences of equal length share a bucket, so no
sequence crosses documents and none needs padding. Null text counts as empty (one end token, one piece of length 1).
Rows that repeat are packed once each; very long texts only give more pieces; an empty table gives no sequences.
"""

from __future__ import annotations

import array
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from matchgrid.llm.common import map_batches, numbered, stored

#: Words and word parts whose ids a task keeps. A full table becomes the old one, from which words still in use are taken
#: over, so memory is bounded and results do not change.
WORD_TABLE = PART_TABLE = 100_000
MAX_LENGTH = 4096
#: Texts tokenized at a time: they bound a worker's memory.
TEXTS = 256
#: Lower-case letters that have one form only, then ASCII marks.
PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


LETTERS = byte_letters()


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer.from_file(path)


def byte_level(t: Tokenizer) -> bool:
    """True if a word of plain lower-case letters reaches the merges as the letters of its bytes and nothing else."""
    return isinstance(t.model, models.BPE) and not t.model.dropout and "ByteLevel(add_prefix_space=False" in repr(t.pre_tokenizer)


class Table:
    """A bounded table of two generations."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def room_for(self, n: int) -> bool:
        """False if the table had to be turned over."""
        if len(self.new) + n <= self.size or not self.new:
            return True
        self.new, self.old = {}, self.new
        return False


class Words:
    """Token ids of a text, word by word.

    The tokenizer lower-cases, drops white space and never joins across it, so a text's ids are those of its parts
    between ASCII white space, and each distinct part is tokenized once. Letters and a tail of ASCII marks are always
    tokenized apart, so both are looked up alone; plain letters go to the tokenizer's merges at once, as its normalising
    and splitting steps leave them as they are.
    """

    def __init__(self, path: str):
        self.tokenizer = tokenizer(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.model = self.tokenizer.model if byte_level(self.tokenizer) else None
        self.ids, self.parts = Table(WORD_TABLE), Table(PART_TABLE)

    def part(self, p: str, plain: bool) -> bytes:
        t = self.parts
        found = t.new.get(p)
        if found is None:
            found = t.old.get(p)
            if found is None:
                if plain and self.model:
                    ids = [k.id for k in self.model.tokenize(p.encode().decode("latin-1").translate(LETTERS))]
                else:
                    ids = self.tokenizer.encode(p, add_special_tokens=False).ids
                found = array.array("I", ids).tobytes()
            t.room_for(1)
            t.new[p] = found
        return found

    def word(self, w: bytes) -> bytes:
        text = w.decode()
        m = PLAIN.fullmatch(text)
        if not m:
            return self.part(text, False)
        letters, marks = m.groups()
        return self.part(letters, True) + self.part(marks, False) if marks else self.part(letters, True)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids per text as little-endian unsigned 32-bit integers."""
        for t in texts:
            raw = (t or "").encode()
            low = raw.lower()
            # Lower-casing first makes fewer distinct parts; not where it could turn text into a special token.
            words = (raw if any(s in low for s in self.special) else low).split()
            distinct = set(words)
            new = distinct.difference(self.ids.new)
            if new and not self.ids.room_for(len(new)):
                new = distinct
            known, old = self.ids.new, self.ids.old
            for w in new:
                known[w] = old.get(w) or self.word(w)
            yield b"".join(map(known.__getitem__, words))


def piece_lengths(n: int, longest: int = MAX_LENGTH) -> list[int]:
    """Lengths in falling order: whole sequences, then the binary digits of what is left."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def decompose(docs: DataFrame, tokenizer: str, end_id: int, longest: int = MAX_LENGTH, key: str = "doc_id", text: str = "text",
              keep_ids: bool = True) -> DataFrame:
    """One row per piece: key, ``start``, ``length``, ``ids_crc32``, ``doc_tokens`` and, if wanted, the ids themselves."""
    if longest & (longest - 1):
        raise ValueError("the longest length must be a power of two")
    kind = docs.schema[key].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def make():
        w = Words(tokenizer)

        def cut_up(b: pa.RecordBatch) -> pa.Table:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for i, raw in enumerate(w.encode(b.column(1).to_pylist())):
                raw += end
                n, at = len(raw) // 4, 0
                for size in piece_lengths(n, longest):
                    cut = raw[4 * at : 4 * (at + size)]
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(cut))
                    total.append(n)
                    if keep_ids:
                        ids.append(np.frombuffer(cut, "<i4"))
                    at += size
            cols = [b.column(0).take(pa.array(row, pa.int64()))] + [pa.array(c, pa.int64()) for c in (start, length, crc, total)]
            names = [key, "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                cols.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            return pa.table(cols, names=names)

        return lambda b: (cut_up(b.slice(at, TEXTS)) for at in range(0, b.num_rows, TEXTS))

    schema = f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    return map_batches(docs.select(F.col(key), F.col(text)), make, schema)


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = MAX_LENGTH, key: str = "doc_id", text: str = "text",
         keep_ids: bool = True) -> DataFrame:
    """Pieces with ``sequence_id`` (gapless, long buckets first, then by document and start) and ``offset`` (0: a piece
    is its whole sequence)."""
    order = [F.col("length").desc(), F.col(key), F.col("start"), F.col("ids_crc32")]
    # Stored first: range partitioning reads its input twice, and no text should be tokenized twice.
    pieces = decompose(docs, tokenizer, end_id, longest, key, text, keep_ids)
    if not keep_ids:
        d = numbered(stored(pieces), order, "sequence_id")
    else:
        # Numbered without their ids: long pieces are neighbours in the order, and one range of them would hold most bytes.
        pieces = stored(pieces.withColumn("__piece", F.monotonically_increasing_id()))
        numbers = numbered(pieces.select("__piece", key, "start", "length", "ids_crc32"), order, "sequence_id")
        d = pieces.join(numbers.select("__piece", "sequence_id"), "__piece").drop("__piece")
    return d.withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder per length, so a trainer can read batches of equal shape."""
    packed.select("sequence_id", "ids", "length").write.partitionBy("length").parquet(path)
