"""Catalog, chunk store, views, statistics, state machine and memo cache."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Allowed transitions of a document. Fixed values.
TRANSITIONS = {"RECEIVED": ("PARSING", "FAILED"), "PARSING": ("PARSED", "FAILED"), "PARSED": ("ARCHIVED",), "FAILED": ("RECEIVED", "ARCHIVED"), "ARCHIVED": ()}


def upsert(rows: DataFrame, key: str, seq: str) -> DataFrame:
    """Of each key the last row, at the place of the first."""
    columns = [c for c in rows.columns if c not in (key, seq)]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), seq).alias("r"), F.min(seq).alias(seq)).select(key, seq, *[f"r.{c}" for c in columns])


def listed(catalog: DataFrame) -> DataFrame:
    """R2."""
    return catalog.orderBy(F.desc("created_at"), "ingest_seq")


def without(rows: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """Rows whose key isn't gone; silent where it wasn't there."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def existing(ids: DataFrame, catalog: DataFrame, key: str = "document_id") -> DataFrame:
    """R4."""
    return ids.join(catalog.select(key), key, "left_semi")


def base_name(uri: Column) -> Column:
    """R5."""
    return F.substring_index(uri, "/", -1)


def documents_view(catalog: DataFrame) -> DataFrame:
    """R6."""
    return listed(catalog).select("document_id", "name", "state", F.col("created_at").alias("uploaded_at"))


def source_names(sources: DataFrame, catalog: DataFrame) -> DataFrame:
    """R13; Catalyst broadcasts the catalog where its size allows."""
    return sources.join(catalog.select("document_id", "name"), "document_id", "left").withColumn("name", F.coalesce("name", F.lit("belge")))


def stats(**tables: DataFrame) -> DataFrame:
    """One row, the number of rows of each table."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.count(F.lit(1)).alias(name))
        out = one if out is None else out.crossJoin(one)  # one row each
    return out


def allowed(state: Column, target: Column) -> Column:
    """M1."""
    pairs = [F.lit(f"{a}>{b}") for a, to in TRANSITIONS.items() for b in to]
    return F.array_contains(F.array(*pairs), F.concat(state, F.lit(">"), target))


def checked_log(events: DataFrame, seq: str = "seq") -> DataFrame:
    """A document's transitions with the state before each and whether it was legal; a document begins as received."""
    before = F.lag("target", 1, "RECEIVED").over(Window.partitionBy("document_id").orderBy(seq))
    return events.withColumn("state", before).withColumn("legal", allowed(F.col("state"), F.col("target")))


def memoised(asked: DataFrame, memo: DataFrame, new: DataFrame, key: str = "key") -> DataFrame:
    """L3: asked with the answers of the memo and of its new rows; answers are null where neither has one."""
    return asked.join(memo.select(key, "answer").unionByName(new.select(key, "answer")), key, "left")


def numbered(rows: DataFrame, order: list[str], save, name: str = "number") -> DataFrame:
    """rows with their number from 1 in the order: a range partition is numbered by itself, then moved
    by the sizes of those before it (one row a partition). save writes a table and reads it back."""
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = save(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__in": inside}))
    sizes = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("__part", F.coalesce(before, F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").withColumn(name, F.col("__start") + F.col("__in") + 1).drop("__part", "__in", "__start")


def cache_accounting(asked: DataFrame, key: str = "key") -> DataFrame:
    """hits and misses of an empty cache over the prompts asked."""
    return asked.groupBy(key).agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("misses"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("hits"))
