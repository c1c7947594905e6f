"""One ordered pass per key for results that depend on a sequential rule.

Spark partitions by the key and sorts inside the partitions; the pass then reads Arrow batches in that
order and keeps only the small running state of the current key. A group is never collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame


def ordered_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column | str],
    make: Callable[[tuple], object],
    schema: str,
    out_rows: int = 16384,
    sent: Sequence[str] = (),
) -> DataFrame:
    """Feed the rows of each key, in order, to ``make(key)``; of each row the columns ``sent``, where they are named.

    The object has ``step(row) -> iterable of tuples`` and ``close() -> iterable of tuples``; ``row`` is a
    named tuple. Output tuples follow ``schema``.
    """
    keys = list(keys)
    names = [part.strip().split()[0] for part in schema.split(",")]
    placed = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    placed = placed.select(*sent) if sent else placed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, worker, out = None, None, []
        for pdf in batches:
            if pdf.empty:
                continue
            key_cols = [pdf[k].tolist() for k in keys]
            for key, row in zip(zip(*key_cols, strict=True), pdf.itertuples(index=False, name="Row"), strict=True):
                if key != current:
                    if worker is not None:
                        out.extend(worker.close())
                    current, worker = key, make(key)
                out.extend(worker.step(row))
            if len(out) >= out_rows:
                yield pd.DataFrame(out, columns=names)
                out = []
        if worker is not None:
            out.extend(worker.close())
        if out:
            yield pd.DataFrame(out, columns=names)

    return placed.mapInPandas(run, schema=schema)


class _Frames:
    """Gathers the rows of one frame and hands them on together."""

    def __init__(self, key: tuple, core):
        self.key, self.core, self.f, self.rows = key, core, None, []

    def _hand_on(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return [(*self.key, *r) for r in self.core.frame(self.f, rows)] if rows else []

    def step(self, row):
        n = len(self.key)
        out = self._hand_on() if row[n] != self.f else ()
        self.f = row[n]
        self.rows.append(row[n + 1 :])
        return out

    def close(self):
        out = self._hand_on()
        end = getattr(self.core, "end", None)
        return out + [(*self.key, *r) for r in end()] if end else out


def frame_scan(df: DataFrame, keys: Sequence[str], frame: str, cols: Sequence[str], make: Callable[[], object], schema: str) -> DataFrame:
    """Ordered pass in steps of whole frames, rows of a frame in the order of their first column of ``cols``.

    The object has ``frame(f, rows) -> iterable of tuples`` and, where something is left at the end, ``end()``. ``schema``
    begins with the keys. A frame is held in memory, a key is not.
    """
    d = df.select(*keys, frame, *cols)
    return ordered_scan(d, keys, [frame, cols[0]], lambda key: _Frames(key, make()), schema)
