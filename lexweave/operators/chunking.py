"""Sliding windows of whole words, with an overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def cut(text: str, size: int, overlap: int) -> list[str]:
    """Greedy chunks of at most size characters (each word counts one more, for its blank).

    A chunk begins with the longest run of the last words that fits the overlap; the word after
    that is taken unseen, so a chunk may exceed the size by a long word.
    """
    chunks: list[str] = []
    words = text.split()
    cost = [len(w) + 1 for w in words]
    begin = used = 0
    for k, c in enumerate(cost):
        if k > begin and used + c > size:
            chunks.append(" ".join(words[begin:k]))
            begin, used = k, 0
            while begin and used + cost[begin - 1] <= overlap:
                begin -= 1
                used += cost[begin]
        used += c
    if words:
        chunks.append(" ".join(words[begin:]))
    return chunks


def chunk(docs: DataFrame, size: int = 500, overlap: int = 50, key: str = "document_id", text: str = "text") -> DataFrame:
    """key, ord, text of every chunk: a map over partitions, in Arrow batches."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap within [0, size)")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [cut(t or "", size, overlap) for t in batch.column(1).to_pylist()]
            keys = batch.column(0).take(pa.array([k for k, c in enumerate(made) for _ in c], pa.int64()))
            yield pa.RecordBatch.from_arrays([keys, pa.array([i for c in made for i in range(len(c))], pa.int32()), pa.array([x for c in made for x in c], pa.string())], [key, "ord", "text"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, ord int, text string")
