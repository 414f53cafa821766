"""Hierarchical packing of documents into sequences of several context sizes.

Whole windows of the longest size are cut from a document first. What remains is routed to the
tier of the smallest context size that holds it; each tier's windows are packed with its own
pieces, gaps are filled with the largest pieces of shorter tiers that fit, and a gap that none
fits is closed by cutting the shortest piece. So every window is exactly full, except one at
the end of a partition. Sequences are dealt to the least loaded of a few step groups, so that
the groups of a partition hold nearly equal numbers of ids.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from lexweave.llm.common import crc32, gathered, map_batches, tokenizer_path
from lexweave.llm.wordcache import encoder

#: Context sizes; a full window of any of them needs no padding.
TIERS = (64, 128, 256, 512, 1024, 2048)
#: Ids that a task gathers before it packs, and ids that it keeps then, to have pieces of all lengths to choose from.
GATHER, KEEP = 1 << 20, 1 << 17


class Packer:
    """Packs the pieces of one partition; pieces are (doc_id, start, packed ids, ids of the document)."""

    def __init__(self, tiers: tuple[int, ...] = TIERS, first_sequence: int = 0, step_groups: int = 8):
        self.tiers, self.sequence = sorted(tiers), first_sequence
        self.pieces: dict[int, list] = defaultdict(list)  # by their number of ids
        self.lengths: list[int] = []  # those there are, ascending
        self.total = 0
        self.groups = [(0, g) for g in range(step_groups)]
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: bytes) -> None:
        n, longest = len(ids) // 4, self.tiers[-1]
        whole = n - n % longest
        for start in range(0, whole, longest):
            self._emit(longest, [(doc_id, start, ids[4 * start : 4 * (start + longest)], n)])
        if whole < n:
            self._put((doc_id, whole, ids[4 * whole :], n))

    def pack(self, keep: int = 0) -> None:
        """Packs pieces until no more than keep ids are left; 0: all."""
        while self.total > keep:
            longest = self.lengths[-1]
            tier = self.tiers[bisect_right(self.tiers, longest - 1)]
            if tier > self.total:  # the end: the largest context that can still be full, or what is left of it
                tier = self.tiers[max(0, bisect_right(self.tiers, self.total) - 1)]
            self._emit(tier, self._window(min(tier, self.total)))

    def _window(self, gap: int) -> list:
        """Pieces that fill the gap exactly."""
        taken = []
        while gap:
            k = bisect_right(self.lengths, gap)
            piece = self._take(self.lengths[k - 1] if k else self.lengths[0])
            if not k:
                doc_id, start, ids, n = piece
                self._put((doc_id, start + gap, ids[4 * gap :], n))
                piece = (doc_id, start, ids[: 4 * gap], n)
            taken.append(piece)
            gap -= len(piece[2]) // 4
        return taken

    def _put(self, piece: tuple) -> None:
        n = len(piece[2]) // 4
        if not self.pieces[n]:
            insort(self.lengths, n)
        self.pieces[n].append(piece)
        self.total += n

    def _take(self, n: int) -> tuple:
        piece = self.pieces[n].pop()
        if not self.pieces[n]:
            self.lengths.remove(n)
        self.total -= n
        return piece

    def _emit(self, tier: int, pieces: list) -> None:
        load, group = heapq.heappop(self.groups)
        offset = 0
        for doc_id, start, ids, n in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, crc32(ids), n, self.sequence, offset, tier, group))
            offset += length
        heapq.heappush(self.groups, (load + offset, group))
        self.sequence += 1


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, step_group int"
_ARROW = pa.schema([*((c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), ("context", pa.int32()), ("step_group", pa.int32())])


def pack(docs: DataFrame, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_groups: int = 8, path: str | None = None) -> DataFrame:
    """One row a piece: where its ids lie in its document and in its sequence.

    A map over partitions: no shuffle, and a task holds at most GATHER ids besides one document.
    Null and empty texts are the end id alone; repeated rows are packed each; an empty table
    gives no rows. sequence_id is the partition's number times 2^32 plus a count within it.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, task = encoder(path), TaskContext.get()
        packer = Packer(tiers, (task.partitionId() if task else 0) << 32, step_groups)

        def done():
            rows, packer.rows = packer.rows, []
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)

        for batch in gathered(batches):
            ids, ends = code.encode_all(batch.column("text"), end_id)
            packed, begin = ids.tobytes(), 0
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                packer.add(doc_id, packed[4 * begin : 4 * end])
                begin = end
                if packer.total > GATHER:
                    packer.pack(KEEP)
            if packer.rows:
                yield done()
        packer.pack()
        if packer.rows:
            yield done()

    return map_batches(docs.select("doc_id", "text"), run, SCHEMA)
