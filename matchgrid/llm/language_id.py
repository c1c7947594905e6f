"""Language identification with segmentation-marginalised unigrams.

Every language has a probability for each piece of a fixed public vocabulary. A word's probability in a language is the
sum over all its segmentations into pieces, by a forward pass; a text's is the product over its words. Pieces never go
across words, so this is the sum over all segmentations of the text. Piece probabilities are learnt by expectation
maximisation: the expected number of uses of each piece over all segmentations of the labelled words.

Words are maximal runs of letters in lower case. A text that is null or has no letter gets ``und`` with score 0.
Training rows with a null label are left out; with no labelled row at all every text is ``und``. Repeated rows count as
often as they occur.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchgrid.llm.common import map_batches, stored, unstore

WORD = re.compile(r"[^\W\d_]+")
#: Expected number of training documents per language: the documented bound of the training sample.
TRAINING_DOCS = 3_000
ROUNDS = 3
#: Added to every expected count, so that an unseen piece keeps a chance.
PRIOR = 0.05
#: Words whose scores a worker keeps; the table is emptied when full.
WORD_TABLE = 200_000
MARK = "▁"
#: Words up to this length are summed under a scale of LETTER per letter; longer ones under a scale per place.
PLAIN_LENGTH, LETTER = 48, 30.0
UNKNOWN = "und"


@lru_cache(maxsize=2)
def matcher(path: str) -> ahocorasick.Automaton:
    """Finds every piece inside a text; a match carries its length and id."""
    a = ahocorasick.Automaton()
    for piece, i in vocabulary(path)[0].items():
        a.add_word(piece, len(piece) << 20 | i)
    a.make_automaton()
    return a


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[dict[str, int], dict[int, int], int]:
    """Ids of the ordinary pieces, ids of the byte pieces, number of ids."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, of_byte = {}, {}
    for i in range(model.get_piece_size()):
        p = model.id_to_piece(i)
        if model.is_byte(i):
            of_byte[int(p[3:-1], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i)):
            pieces[p] = i
    return pieces, of_byte, model.get_piece_size()


class Lattice:
    """Forward and backward passes over the segmentations of many words of one length at a time."""

    def __init__(self, path: str, table: np.ndarray):
        self.pieces, self.of_byte, self.table = *vocabulary(path)[:2], table
        self.matcher = matcher(path)

    def edges(self, words: list[str]) -> list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, list]]:
        """``start, end, rows, ids, probabilities, spelt`` by rising end: the rows that have a piece at that place. A
        character outside the vocabulary is an edge spelt in its byte pieces."""
        n = len(words[0])
        found = np.fromiter(chain.from_iterable(self.matcher.iter("\n".join(words))), np.int64).reshape(-1, 2)
        row, end = found[:, 0] // (n + 1), found[:, 0] % (n + 1) + 1
        size, ids = found[:, 1] >> 20, found[:, 1] & ((1 << 20) - 1)
        start = end - size
        place = end * (n + 1) + start
        order = np.argsort(place, kind="stable")
        row, ids, place = row[order], ids[order], place[order]
        cut = np.searchsorted(place, np.arange((n + 1) * (n + 1) + 1))
        out = []
        for e in range(1, n + 1):
            for st in range(e):
                k = e * (n + 1) + st
                rows, of = row[cut[k] : cut[k + 1]], ids[cut[k] : cut[k + 1]]
                if st == e - 1 and len(rows) < len(words):
                    lost = np.setdiff1d(np.arange(len(words)), rows)
                    spelt = [[self.of_byte[b] for b in words[r][st].encode()] for r in lost]
                    out.append((st, e, lost, None, np.array([self.table[x].prod(axis=0) for x in spelt]), spelt))
                if len(rows):
                    out.append((st, e, rows, of, self.table[of], []))
        return out

    def forward(self, words: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], list]:
        """Scaled sums per position, the logarithm of the scale, and the edges; words have one length."""
        shape = (len(words), self.table.shape[1])
        alpha, scale, edges = [np.ones(shape)], [np.zeros(len(words))], self.edges(words)
        at = 0
        for end in range(1, len(words[0]) + 1):
            total = np.zeros(shape)
            while at < len(edges) and edges[at][1] == end:
                start, _, rows, _, p, _ = edges[at]
                total[rows] += alpha[start][rows] * p * np.exp(scale[start][rows] - scale[-1][rows])[:, None]
                at += 1
            most = np.maximum(total.max(axis=1), 1e-300)
            alpha.append(np.maximum(total / most[:, None], 1e-200))
            scale.append(scale[-1] + np.log(most))
        return alpha, scale, edges

    def log_scores(self, words: list[str]) -> np.ndarray:
        """Log probability of each word in each language."""
        out = np.zeros((len(words), self.table.shape[1]))
        for rows in by_length(words):
            group = [MARK + words[i] for i in rows]
            n = len(group[0])
            if n > PLAIN_LENGTH:
                alpha, scale, _ = self.forward(group)
                out[rows] = np.log(alpha[-1]) + scale[-1][:, None]
                continue
            # The same sums under one fixed scale per letter, which cannot leave the range of doubles at this length.
            sums = np.zeros((n + 1, len(group), self.table.shape[1]))
            sums[0] = 1.0
            for start, end, at, _, p, _ in self.edges(group):
                p = p * LETTER ** (end - start)
                if len(at) == len(group):
                    sums[end] += sums[start] * p
                else:
                    sums[end][at] += sums[start].take(at, axis=0) * p
            out[rows] = np.log(np.maximum(sums[n], 1e-300)) - n * np.log(LETTER)
        return out

    def expected(self, words: list[str], weights: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, weighted per word and language."""
        out = np.zeros_like(self.table)
        for rows in by_length(words):
            group = [MARK + words[i] for i in rows]
            alpha, scale, edges = self.forward(group)
            n = len(group[0])
            beta = [np.zeros_like(alpha[0]) for _ in range(n)] + [weights[rows] / alpha[-1]]
            for start, end, at, ids, p, spelt in reversed(edges):
                # Edges come by rising end, so beta[end] is complete here.
                flow = p * beta[end][at] * np.exp(scale[start][at] - scale[end][at])[:, None]
                beta[start][at] += flow
                used = alpha[start][at] * flow
                if ids is not None:
                    np.add.at(out, ids, used)
                for j, pieces in enumerate(spelt):
                    np.add.at(out, pieces, np.broadcast_to(used[j], (len(pieces), used.shape[1])))
        return out


def by_length(words: list[str], most: int = 4_000) -> list[list[int]]:
    """Row numbers of words of equal length, in groups whose arrays stay small."""
    groups: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        groups.setdefault(len(w), []).append(i)
    return [g[a : a + size] for n, g in groups.items() for size in [max(1, most * 8 // max(8, n))] for a in range(0, len(g), size)]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def has_letter(word: str) -> bool:
    """The word pattern also takes number signs such as fractions."""
    return any(map(str.isalpha, word))


def sample(docs: DataFrame, label: str = "lang", key: str = "doc_id", per_label: int = TRAINING_DOCS) -> DataFrame:
    """About ``per_label`` labelled rows of each label, chosen by a hash of the key."""
    known = docs.where(F.col(label).isNotNull())
    share = known.groupBy(F.col(label).alias("__l")).agg((F.lit(float(per_label)) / F.count("*")).alias("__share"))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)
    # One number per language goes to the rows; no text is moved.
    return known.join(F.broadcast(share), F.col(label) == F.col("__l")).where(draw < F.col("__share")).drop("__l", "__share")


def fit(docs: DataFrame, vocab: str, label: str = "lang", text: str = "text", rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Labels in order and the table of piece probabilities (ids x labels). The table is bounded by the vocabulary."""

    def make_count():
        def step(b: pa.RecordBatch) -> pa.Table:
            seen: Counter = Counter()
            for lang, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                seen.update((lang, w) for w in words_of(t))
            keys = list(seen)
            return pa.table([pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

        return step

    counts = map_batches(docs.select(F.col(label).cast("string").alias("lang"), F.col(text).alias("text")), make_count, "lang string, word string, n long")
    table = counts.groupBy("lang", "word").agg(F.sum("n").alias("n")).where("lang is not null")
    words = stored(table.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("uses")))
    labels = [r[0] for r in words.select(F.explode(F.map_keys("uses")).alias("l")).distinct().orderBy("l").collect()]  # one row per language
    size = vocabulary(vocab)[2]
    model = np.full((size, len(labels)), 1.0 / size)
    place = {x: j for j, x in enumerate(labels)}

    for _ in range(rounds if labels else 0):

        def make_expect(model=model):
            lattice = Lattice(vocab, model)

            def step(b: pa.RecordBatch) -> pa.Table:
                group, weights = b.column(0).to_pylist(), np.zeros((b.num_rows, len(labels)))
                for i, uses in enumerate(b.column(1).to_pylist()):
                    for lang, n in uses:
                        weights[i, place[lang]] = n
                e = lattice.expected(group, weights)
                ids = np.flatnonzero(e.any(axis=1))
                return pa.table([pa.array(ids, pa.int32()), pa.array(list(e[ids]), pa.list_(pa.float64()))], names=["piece", "uses"])

            return step

        used = map_batches(words, make_expect, "piece int, uses array<double>")
        sums = used.groupBy("piece").agg(*[F.sum(F.col("uses")[j]).alias(f"s{j}") for j in range(len(labels))])
        e = np.full((size, len(labels)), PRIOR)
        for r in sums.collect():  # at most one row per piece of the vocabulary
            e[r[0]] += r[1:]
        model = e / e.sum(axis=0)
    unstore(words)
    return labels, model


class Scorer:
    def __init__(self, vocab: str, labels: list[str], model: np.ndarray):
        self.labels, self.lattice = labels, Lattice(vocab, model)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.scores = np.zeros((0, len(self.labels)))
        self.letters = np.zeros(0, bool)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = []
        for a in range(0, len(texts), 500):
            found = [words_of(t) for t in texts[a : a + 500]]
            new = list(set().union(*found) - self.place.keys())
            if len(self.place) + len(new) > WORD_TABLE and self.place:
                self.clear()
                new = list(set().union(*found))
            if new:
                start = len(self.place)
                self.place.update((w, start + i) for i, w in enumerate(new))
                rows = self.lattice.log_scores(new) if self.labels else np.zeros((len(new), 0))
                if start + len(new) > len(self.letters):  # grow by half, so that adding stays cheap
                    room = max(start + len(new), len(self.letters) * 3 // 2)
                    self.scores = np.vstack([self.scores[:start], np.zeros((room - start, rows.shape[1]))])
                    self.letters = np.concatenate([self.letters[:start], np.zeros(room - start, bool)])
                self.scores[start : start + len(new)] = rows
                self.letters[start : start + len(new)] = [has_letter(w) for w in new]
            out += map(self.decide, found)
        return out

    def decide(self, words: list[str]) -> tuple[str, float]:
        at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
        if not self.labels or not self.letters[at].any():
            return UNKNOWN, 0.0
        total = self.scores[at].sum(axis=0)
        best = int(total.argmax())
        return self.labels[best], float(1.0 / np.exp(total - total[best]).sum())


def predict(docs: DataFrame, vocab: str, labels: list[str], model: np.ndarray, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, lang_pred, score``: the most probable language and its share among all languages, equal priors."""
    kind = docs.schema[key].dataType.simpleString()

    def make():
        scorer = Scorer(vocab, labels, model)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            found = scorer.predict(b.column(1).to_pylist())
            return pa.record_batch([b.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                   names=[key, "lang_pred", "score"])

        return step

    return map_batches(docs.select(F.col(key), F.col(text)), make, f"`{key}` {kind}, lang_pred string, score double")


def held_out(key: str = "doc_id"):
    """One row in five, by the checksum of the key as text; a null key is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def classified(docs: DataFrame, vocab: str, labels: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with ``__lang`` and ``__score``."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", __lang string, __score double"

    def make():
        scorer = Scorer(vocab, labels, model)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            found = scorer.predict(b.column(b.schema.get_field_index(text)).to_pylist())
            return pa.record_batch([*b.columns, pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                                   names=[*b.schema.names, "__lang", "__score"])

        return step

    return map_batches(docs, make, schema)
