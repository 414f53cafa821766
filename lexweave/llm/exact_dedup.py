"""Exact deduplication of whole texts, safe with groups of any size; DataFrame functions only.

Texts are equal when they are after white space is deleted. Three merges, each of which groups
by the digest and by the whole text itself, so that a clash of digests never joins two texts:
within a task (the map side of the first aggregation), within a salted part of the digest's
rows, and over the salts. A group of copies thus shrinks to a row a task and then to one a
salt before it meets in one place. Rows are then told their group by a tag (the digest, a second
hash and the length); tags that several texts share are found first, and rows of those are told
by their content.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import ASCII_SPACE, shared_table, unused

#: Parts that the rows of one digest are dealt to.
SALTS = 16


def squeezed(text: Column) -> Column:
    """The text without white space; null as empty."""
    text = F.coalesce(text, F.lit(""))
    for c in ASCII_SPACE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def check(content: Column) -> Column:
    return F.xxhash64(content)


def groups(docs: DataFrame, digest_of=digest, check_of=check, salts: int = SALTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row, dropped ones too.

    Of a group the row whose original text has the most code points stays, then the smallest
    doc_id (a null doc_id comes last). Rows that repeat a doc_id are rows of the group like any
    other, and kept is true for each that has the keep_id. Null counts as an empty text. Empty
    tables give no rows. Other columns of docs are ignored. A row a group (its tag, no text) goes
    to the shared folder.
    """
    rows = docs.select("doc_id", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"), squeezed(F.col("text")).alias("content"))
    rows = rows.select("doc_id", "n", "content", digest_of(F.col("content")).alias("digest"))
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id")))
    salted = (
        rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(salts)))
        .groupBy("digest", "salt", "content").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
    )
    merged = salted.groupBy("digest", "content").agg(F.min("best").alias("best"), F.sum("size").alias("group_size"))
    merged = merged.select("digest", "content", F.col("best.doc_id").alias("keep_id"), "group_size")
    tag, own = ["digest", "check", "long"], (check_of(F.col("content")).alias("check"), F.length("content").alias("long"))
    by_tag = merged.select("digest", *own, "keep_id", "group_size").groupBy(*tag)
    of = shared_table(by_tag.agg(F.min("keep_id").alias("keep_id"), F.min("group_size").alias("group_size"), F.count(F.lit(1)).alias("texts")), "exact-groups")
    told = rows.select("doc_id", "digest", *own).join(of.filter("texts = 1"), tag).select("doc_id", "digest", "keep_id", "group_size")
    several = of.filter("texts > 1").select(*tag)
    if not several.isEmpty():
        of_content = merged.select("content", "digest", *own, "keep_id", "group_size").join(several, tag, "left_semi").select("content", "keep_id", "group_size")
        their = rows.select("doc_id", "content", "digest", *own).join(several, tag, "left_semi")
        told = told.unionByName(their.join(of_content, "content").select("doc_id", "digest", "keep_id", "group_size"))
    return told.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "digest")


def deduplicate(docs: DataFrame, salts: int = SALTS) -> DataFrame:
    """The rows of docs, all columns whatever their names, that stay; of rows with the same doc_id and content, one.

    A row is found by its doc_id and digest. Rows are moved once: the join and the choice among
    repeated rows are dealt by the same keys.
    """
    name = unused(docs.columns, "id", "none", "tag")
    keys = [F.coalesce(F.col("doc_id"), F.lit(0)).alias(name[0]), F.col("doc_id").isNull().alias(name[1])]
    kept = groups(docs, salts=salts).filter("kept").select(*keys, F.col("digest").alias(name[2]))
    rows = docs.select(*[f"`{c}`" for c in docs.columns], *keys, digest(squeezed(F.col("text"))).alias(name[2]))
    return rows.join(kept, name, "left_semi").dropDuplicates(name).select(*[f"`{c}`" for c in docs.columns])
