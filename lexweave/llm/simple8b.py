"""Token-id output in a word-aligned binary format (Simple-8b), and its reader.

A 64-bit word holds a 4-bit selector and, by it, a fixed count of equally wide ids. Selector 0
is an escape: the next word is one value of up to 64 bits. A block is

    magic, docs, ids, words, bytes of the index (5 x uint32)   ids before it in its shard (uint64)
    doc_id (int64) and a validity byte of each document, ids of each document (uint64)
    index: for every INDEX_WORDS-th word, the ids before it (uint64)
    words (uint64)

all little-endian. A shard is a range of doc_id, its blocks rows of a Parquet table, so that
Spark's commit protocol makes a lost task's output whole or absent.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import crc32, gathered, map_batches, shared_table, tokenizer_path
from lexweave.llm.wordcache import encoder

MAGIC = 0x31423853  # "S8B1"
#: Selector k (from 1): ids in a word; each has 60 // count bits.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // c for c in COUNTS)
INDEX_WORDS = 512
#: A block is closed at so many ids; a longer document makes one longer block.
BLOCK_IDS = 1 << 16
_POWERS = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))


def pack_words(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, ids before each word) of the values; greedy: as many ids in each word as fit."""
    n = len(values)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    values = values.astype(np.uint64)
    width = np.searchsorted(_POWERS, values, side="right").astype(np.uint8)
    mode, widest, taken = np.zeros(n, np.int64), width.copy(), 1  # mode 0: escape
    for k in range(len(COUNTS), 0, -1):  # growing counts; the larger wins
        while taken < COUNTS[k - 1] and taken < n:  # widest: of the value and of those after it, which count as 0 beyond the end
            np.maximum(widest[: n - taken], width[taken:], out=widest[: n - taken])
            taken += 1
        fits = widest <= BITS[k - 1]
        if not fits.any():  # nor will more values fit fewer bits
            break
        mode[fits] = k
    steps = np.array((1, *COUNTS))[mode].tolist()
    starts, i = [], 0
    while i < n:
        starts.append(i)
        i += steps[i]
    starts = np.array(starts)
    chosen = mode[starts]
    place = np.arange(len(starts)) + np.cumsum(chosen == 0) - (chosen == 0)  # an escape takes two words
    words = np.zeros(len(starts) + int((chosen == 0).sum()), np.uint64)
    before = np.empty(len(words), np.int64)
    before[place] = starts
    padded = np.concatenate([values, np.zeros(max(COUNTS), np.uint64)])
    for k in np.unique(chosen):
        own = chosen == k
        s, p = starts[own], place[own]
        if k == 0:
            words[p + 1], before[p + 1] = values[s], s
            continue
        word = np.full(len(s), np.uint64(int(k) << 60))
        for j in range(COUNTS[k - 1]):
            word |= padded[s + j] << np.uint64(j * BITS[k - 1])
        words[p] = word
    return words, before


def unpack_words(words: np.ndarray, n: int) -> np.ndarray:
    """The n values in the words, a selector at a time."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    if (selector == 0).any():  # the word after an escape is a value, whatever its upper bits
        raw, k = np.zeros(len(words), bool), 0
        for k in np.flatnonzero(selector == 0):
            if not raw[k]:
                raw[k + 1] = True
    else:
        raw = np.zeros(len(words), bool)
    count = np.where(raw, 0, np.array((1, *COUNTS))[np.where(raw, 0, selector)])
    start = np.cumsum(count) - count
    out = np.zeros(n + max(COUNTS), np.uint64)
    for k in np.unique(selector[~raw]):
        own = np.flatnonzero((selector == k) & ~raw)
        if k == 0:
            out[start[own]] = words[own + 1]
            continue
        mask, bits = np.uint64((1 << BITS[k - 1]) - 1), BITS[k - 1]
        for j in range(COUNTS[k - 1]):
            at = start[own] + j
            inside = at < n
            out[at[inside]] = (words[own[inside]] >> np.uint64(j * bits)) & mask
    return out[:n]


def write_block(doc_ids: list, lengths: list[int], ids: np.ndarray, before: int) -> bytes:
    words, first = pack_words(ids)
    index = first[::INDEX_WORDS].astype("<u8").tobytes()
    known = np.array([x is not None for x in doc_ids], "u1").tobytes()
    return b"".join([
        struct.pack("<5IQ", MAGIC, len(doc_ids), len(ids), len(words), len(index), before),
        np.array([x or 0 for x in doc_ids], "<i8").tobytes(), known, np.array(lengths, "<u8").tobytes(), index, words.astype("<u8").tobytes(),
    ])


def read_block(block: bytes) -> tuple[list, list[int], np.ndarray, int]:
    """(doc_ids, ids of each, all ids, ids before the block in its shard)."""
    magic, docs, n, words, index, before = struct.unpack_from("<5IQ", block)
    if magic != MAGIC:
        raise ValueError("not a block of this format")
    at = struct.calcsize("<5IQ")
    doc_ids = np.frombuffer(block, "<i8", docs, at).tolist()
    known = np.frombuffer(block, "u1", docs, at + 8 * docs)
    lengths = np.frombuffer(block, "<u8", docs, at + 9 * docs).tolist()
    ids = unpack_words(np.frombuffer(block, "<u8", words, at + 17 * docs + index), n)
    return [d if k else None for d, k in zip(doc_ids, known, strict=True)], lengths, ids, before


def read_ids(block: bytes, first: int, count: int) -> np.ndarray:
    """ids first, first + 1, ... of a block, decoding only the words from the index entry before them."""
    _, docs, n, words, index, _ = struct.unpack_from("<5IQ", block)
    at = struct.calcsize("<5IQ") + 17 * docs
    before = np.frombuffer(block, "<u8", index // 8, at)
    k = max(0, int(np.searchsorted(before, first, side="right")) - 1)
    if k and k * INDEX_WORDS < words and before[k] == (before[k - 1] if k else -1):
        k -= 1  # an entry between an escape and its value
    own = np.frombuffer(block, "<u8", words, at + index)[k * INDEX_WORDS :]
    skip = int(before[k]) if len(before) else 0
    return unpack_words(own, n - skip)[first - skip : first - skip + count]


def write_tokens(docs: DataFrame, end_id: int = 2, path: str | None = None, name: str = "simple8b") -> DataFrame:
    """Writes every text's ids and end_id in ascending doc_id order; returns the table of blocks, read back.

    docs is dealt by ranges of doc_id and sorted within each; null ids come first, and rows that
    repeat an id go by a hash of their text, so that they too can be dealt to several tasks. One
    shuffle moves each text once; a task streams its texts into blocks and holds a few batches
    and one block at a time. Null and empty texts are the end id alone. An empty table gives no
    block. Other columns of docs are ignored.
    """
    path = path or tokenizer_path()

    def run(batches):
        code, task = encoder(path), TaskContext.get()
        shard, before, k = task.partitionId() if task else 0, 0, 0
        doc_ids, held, size = [], [], 0

        def block():
            nonlocal before, k, doc_ids, held, size
            data = write_block(doc_ids, [len(own) for own in held], np.concatenate(held), before)
            row = pa.RecordBatch.from_pydict({
                "shard": pa.array([shard], pa.int32()), "block": pa.array([k], pa.int64()), "n_ids": pa.array([size], pa.int64()), "payload": pa.array([data], pa.binary()),
            })
            before, k, doc_ids, held, size = before + size, k + 1, [], [], 0
            return row

        for batch in gathered(batches):
            ids, ends = code.encode_all(batch.column("text"), end_id)
            begin = 0
            for doc_id, end in zip(batch.column("doc_id").to_pylist(), ends.tolist(), strict=True):
                if size and size + end - begin > BLOCK_IDS:
                    yield block()
                doc_ids.append(doc_id)
                held.append(ids[begin:end])
                size, begin = size + end - begin, end
        if size:
            yield block()

    order = F.xxhash64("text"), F.xxhash64("text", F.lit(1))
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", *order).sortWithinPartitions("doc_id", *order)
    return shared_table(map_batches(ordered, run, "shard int, block long, n_ids long, payload binary"), name)


def read_tokens(blocks: DataFrame, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids before it in all shards), n_tokens, ids_crc32 of each document; with_ids: and ids (binary)."""
    schema = "shard int, doc_id long, local long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches):
        for batch in batches:
            for shard, payload in zip(batch.column("shard").to_pylist(), batch.column("payload"), strict=True):
                doc_ids, lengths, ids, before = read_block(payload.as_buffer())
                packed, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(lengths).tolist()
                own = [packed[4 * (e - n) : 4 * e] for e, n in zip(ends, lengths, strict=True)]
                columns = {
                    "shard": pa.array([shard] * len(own), pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "local": pa.array([before + e - n for e, n in zip(ends, lengths, strict=True)], pa.int64()),
                    "n_tokens": pa.array(lengths, pa.int64()), "ids_crc32": pa.array(map(crc32, own), pa.int64()),
                }
                yield pa.RecordBatch.from_pydict(columns | ({"ids": pa.array(map(bytes, own), pa.binary())} if with_ids else {}))

    rows = map_batches(blocks.select("shard", "payload"), run, schema)
    # one row a shard, so a row for each task of the writer: small whatever the ids
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    of_shard = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    found = rows.join(F.broadcast(of_shard), "shard").withColumn("start", F.col("first") + F.col("local"))
    return found.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
