"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in every contract of this subpackage.
ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one of this
    machine where none is set and the master is local, as in tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not own.isDefined():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lexweave-"))
        own = spark.sparkContext._jsc.sc().getCheckpointDir()
    return own.get().rstrip("/")


_WRITTEN: list[list[tuple[str, DataFrame]]] = []


def shared_table(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    if _WRITTEN:
        _WRITTEN[-1].append((path, back))
    return back


@contextlib.contextmanager
def passing_tables(spark: SparkSession) -> Iterator[Callable[[DataFrame], None]]:
    """Removes the tables that shared_table writes within, at the end, save those given to what this yields."""
    _WRITTEN.append([])
    kept: list[DataFrame] = []
    try:
        yield kept.append
    finally:
        for path, table_ in _WRITTEN.pop():
            if not any(table_ is k for k in kept):
                at = spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
            elif _WRITTEN:
                _WRITTEN[-1].append((path, table_))


#: Rows of an Arrow batch at most, as texts may be long; and bytes of texts that gathered() puts together.
BATCH_ROWS, BATCH_BYTES = 1000, 12 << 20


def map_batches(df: DataFrame, batches: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow with small batches; a worker gives free memory back after each task.

    Spark reads the size of a batch from the session when a plan runs, so the session's setting is
    lowered to BATCH_ROWS where it is larger, and stays so; other queries lose no more than a
    little speed by it.
    """
    spark, name = df.sparkSession, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from batches(rows)
        finally:
            give_back()

    return df.mapInArrow(run, schema)


def gathered(batches: Iterator[pa.RecordBatch], most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches put together until they hold `most` bytes: what is done once for each distinct word of a batch pays then."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= most:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held = []
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def words_of(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words as UTF-8, number of each word in order, where each text's words begin and end) of the texts.

    Words are what ASCII white space leaves, null and empty texts have none; lower turns A-Z into a-z.
    """
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat = parts.flatten().cast(pa.large_binary())
    ends = parts.offsets.to_numpy()
    ends = ends - ends[0]
    named = flat.dictionary_encode()
    numbers, empty = named.indices.to_numpy(), named.dictionary.index(b"").as_py()
    if empty >= 0:  # where a text begins or ends with white space
        real = numbers != empty
        ends = np.concatenate([[0], np.cumsum(real)])[ends]
        numbers = numbers[real]
    return named.dictionary, numbers, ends


def give_back() -> None:
    """Returns what the allocators keep for later to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


_RESIDENT: dict = {}


def resident(key, make: Callable):
    """What make() gives for key, kept by the Python worker from task to task.

    A worker keeps one such thing at a time: in a chain of operators their memories take turns
    and don't add up.
    """
    if key not in _RESIDENT:
        _RESIDENT.clear()
        _RESIDENT[key] = make()
    return _RESIDENT[key]


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column (whatever its case) is called so."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def crc32_of(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts, null as empty."""
    return [x or "" for x in batch.column(name).to_pylist()]
