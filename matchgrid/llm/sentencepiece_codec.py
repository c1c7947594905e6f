"""SentencePiece BPE encoding by backtracking, and decoding.

The pieces of a BPE model with distinct merge scores have one valid encoding per text, and a token row is valid exactly
when every two neighbours are: merging their joined text again gives the same two tokens. So a text is encoded from
left to right with the longest piece that fits its left neighbour; where nothing fits, the last token is taken back
and the place is marked in a bit field as one from which no encoding goes on.

Texts are first cut where no piece of the vocabulary can reach across, which leaves the result unchanged; the ids of
such units are kept in a bounded table per worker. Null text is encoded as the empty text. Any Unicode text is valid:
characters outside the vocabulary become their UTF-8 byte pieces. Runs of spaces longer than one are merged directly,
because the pieces for such runs share one score.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import map_batches

SPACE = "▁"
#: Units kept per worker; the table is emptied when full, so memory is bounded and results do not change.
WORD_TABLE = 300_000
UNIT_TABLE = 700_000
PAIR_TABLE = 400_000
#: Texts up to this length are merged by plain search.
SHORT = 48


class Codec:
    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.byte_id, self.text_of, self.id_of, self.score = {}, {}, {}, {}
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:-1], 16)] = i
            elif model.is_unknown(i):
                self.text_of[i] = " ⁇ ".encode()
            elif model.is_control(i):
                self.text_of[i] = b""
            else:
                self.id_of[piece], self.score[piece] = i, model.get_score(i)
                self.text_of[i] = piece.replace(SPACE, " ").encode()
        for b, i in self.byte_id.items():
            self.text_of[i] = bytes([b])
        self.chars = {p for p in self.id_of if len(p) == 1}
        self.joins = {p[j : j + 2] for p in self.id_of for j in range(len(p) - 1)}
        if any(b == SPACE != a for a, b in self.joins):
            raise ValueError("a piece of this vocabulary goes on after a word's end")
        self.words = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.dictionary = ahocorasick.Automaton()
        for p in self.id_of:
            if self.merged(p) == [p]:  # a piece that merging never yields is never a token
                self.dictionary.add_word(p, p)
        self.dictionary.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.word_ids: dict[str, bytes] = {}
        self.unit_ids: dict[str, bytes] = {}

    def merged(self, text: str) -> list[str]:
        """Plain merging: again and again the leftmost neighbours whose joined piece has the best score."""
        if len(text) > SHORT:
            return self.merged_long(text)
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for j in range(len(parts) - 1):
                s = self.score.get(parts[j] + parts[j + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, j
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged_long(self, text: str) -> list[str]:
        """The same with a heap of neighbours, so that time grows with the length and its logarithm only."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int]] = []

        def offer(i: int, put: Callable) -> None:
            if i >= 0 and after[i] < n:
                both = parts[i] + parts[after[i]]
                s = self.score.get(both)
                if s is not None:
                    put(heap, (-s, i, len(both)))

        for i in range(n - 1):
            offer(i, lambda h, x: h.append(x))
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            j = after[i]
            if parts[i] is None or j >= n or len(parts[i]) + len(parts[j]) != size:
                continue  # one of the two has grown or gone since
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], heapq.heappush)
            offer(i, heapq.heappush)
        return [p for p in parts if p is not None]

    def fits(self, left: str, right: str) -> bool:
        ok = self.pairs.get((left, right))
        if ok is None:
            if len(self.pairs) >= PAIR_TABLE:
                self.pairs.clear()
            ok = self.pairs[left, right] = self.merged(left + right) == [left, right]
        return ok

    def backtracked(self, text: str) -> list[str]:
        """Encoding of a text whose characters all are pieces."""
        fits = self.fits
        tokens = [piece for _, piece in self.dictionary.iter_long(text)]
        if all(map(fits, tokens, tokens[1:])):  # the longest matches one after the other already fit
            return tokens
        n = len(text)
        starting: list[list[str]] = [[] for _ in range(n)]
        for end, piece in self.dictionary.iter(text):
            starting[end - len(piece) + 1].append(piece)
        tokens = []
        trials: list[int] = []  # per position on the path: index of the piece to try next, longest first
        dead = 0  # bit i: no valid encoding goes on from i
        pos, trial = 0, len(starting[0]) - 1
        while pos < n:
            here, took = starting[pos], False
            while trial >= 0:
                piece = here[trial]
                after = pos + len(piece)
                trial -= 1
                if not dead >> after & 1 and (not tokens or fits(tokens[-1], piece)):
                    tokens.append(piece)
                    trials.append(trial)
                    pos, took = after, True
                    trial = len(starting[pos]) - 1 if pos < n else -1
                    break
            if not took:
                dead |= 1 << pos
                pos -= len(tokens.pop())
                trial = trials.pop()
        return tokens

    def unit(self, text: str) -> bytes:
        """Ids of a unit, as little-endian unsigned 32-bit integers."""
        out, run = [], ""
        for ch in text:
            if ch in self.chars:
                run += ch
                continue
            if run:
                out += [self.id_of[p] for p in self.backtracked(run)]
                run = ""
            out += [self.byte_id[b] for b in ch.encode()]
        if run:
            tokens = self.merged(run) if SPACE * 2 in run else self.backtracked(run)
            out += [self.id_of[p] for p in tokens]
        return b"".join(i.to_bytes(4, "little") for i in out)

    def word(self, text: str) -> bytes:
        """Ids of one word with the spaces before it: cut where no piece has the two characters next to each other."""
        joins, start, out = self.joins, 0, []
        for j in range(1, len(text) + 1):
            if j == len(text) or text[j - 1 : j + 1] not in joins:
                unit = text[start:j]
                ids = self.unit_ids.get(unit)
                if ids is None:
                    if len(self.unit_ids) >= UNIT_TABLE:
                        self.unit_ids.clear()
                    ids = self.unit(unit)
                    if j - start <= 64:
                        self.unit_ids[unit] = ids
                out.append(ids)
                start = j
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Ids without begin and end, as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        known, out = self.word_ids, []
        for w in self.words.findall(SPACE + text.replace(" ", SPACE)):
            ids = known.get(w)
            if ids is None:
                ids = self.word(w)
                if len(w) <= 64:
                    if len(known) >= WORD_TABLE:
                        known.clear()
                    known[w] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of the ids: byte pieces are read as UTF-8 (broken bytes one by one as U+FFFD), one leading space goes."""
        text_of = self.text_of
        parts = list(map(text_of.__getitem__, ids))
        for j, i in enumerate(ids):
            if i != self.begin and i != self.end:
                if parts[j][:1] == b" " and i != self.byte_id.get(32):
                    parts[j] = parts[j][1:]
                break
        joined = b"".join(parts)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _by_single_bytes(joined)


def _by_single_bytes(raw: bytes) -> str:
    out, at = [], 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                out.append(raw[at : at + size].decode())
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the array column ``ids`` (begin and end ids included). Any other column passes unchanged."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != ids) + f", `{ids}` array<int>"

    def make():
        c = codec(model)
        ends = [c.begin.to_bytes(4, "little"), c.end.to_bytes(4, "little")]

        def step(b: pa.RecordBatch) -> pa.Table:
            import numpy as np

            rows = [np.frombuffer(ends[0] + c.encode(t or "") + ends[1], "<i4") for t in b.column(b.schema.get_field_index(text)).to_pylist()]
            names = [n for n in b.schema.names if n != ids]
            return pa.table([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(rows, pa.list_(pa.int32()))], names=[*names, ids])

        return step

    return map_batches(docs, make, schema)


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ``ids`` (null ids: null text)."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != text) + f", `{text}` string"

    def make():
        c = codec(model)

        def step(b: pa.RecordBatch) -> pa.Table:
            out = [None if x is None else c.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            names = [n for n in b.schema.names if n != text]
            return pa.table([b.column(b.schema.get_field_index(n)) for n in names] + [pa.array(out, pa.string())], names=[*names, text])

        return step

    return map_batches(rows, make, schema)


def round_trip_digest(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` in one pass, without keeping the ids of a batch as lists."""

    def make():
        c = codec(model)
        begin, end = c.begin.to_bytes(4, "little"), c.end.to_bytes(4, "little")

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            n, a, d = [], [], []
            for t in b.column(1):
                raw = begin + c.encode(t.as_py() or "") + end
                n.append(len(raw) // 4)
                a.append(hashlib.sha256(raw).hexdigest())
                d.append(hashlib.sha256(c.decode(memoryview(raw).cast("I").tolist()).encode()).hexdigest())
            return pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())],
                                   names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

        return step

    kind = docs.schema[key].dataType.simpleString()
    return map_batches(docs.select(F.col(key), F.col(text)), make, f"`{key}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
