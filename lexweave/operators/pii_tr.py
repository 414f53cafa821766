"""Masking of personal data in Turkish texts with numbered pseudonyms.

Six passes, each over the output of the one before. Detection is a projection that leaves
marks; only the distinct values are shuffled, to be numbered in the order of first sight.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.validators import valid_tckn
from lexweave.operators import relational
from lexweave.sources.shared import saved

# The forms of the six passes; the last group is the value, what precedes it stays.
_IDENTITY = "[Kk][iıİI][Mm][Ll][iıİI][Kk]"
_NUMBER = "(?:[Nn][Oo]|[Nn][Uu][Mm][Aa][Rr][Aa][Ss][iıİI])"
PASSES = (
    ("IBAN", r"(?U)()(\bTR\d{2}(?:\s?\d{4}){5}\s?\d{2}\b)"),
    ("TCKN", rf"(?U)((?:[Tt]\.?\s*[CcÇç]\.?\s*)?{_IDENTITY}\s*{_NUMBER}\s*[:.]?\s*)(\d{{11}})\b"),
    ("VKN", rf"(?U)([Vv][Ee][Rr][Gg][iıİI]\s*{_IDENTITY}\s*{_NUMBER}\s*[:.]?\s*)(\d{{10}})\b"),
    ("TCKN", r"(?U)()(\b\d{11}\b)"),
    ("EMAIL", r"(?U)()(\b[\w.\-]+@[\w.\-]+\.\w+\b)"),
    ("PHONE", r"(?U)()(\b0?5\d{2}[\s.\-]?\d{3}[\s.\-]?\d{2}[\s.\-]?\d{2}\b)"),
)
CHECKED = 3  # the bare identity number must pass its checksum
#: Stands around a found value's type and number of its pass and place, until it is numbered.
OPEN, CLOSE = "\ue000", "\ue001"
#: What stands for these two signs, and for itself, where the text has them.
ESCAPE, ESCAPED = "\ue002", {"\ue002": "\ue002\ue005", OPEN: "\ue002\ue003", CLOSE: "\ue002\ue004"}


def _pass(rows: DataFrame, k: int) -> DataFrame:
    kind, pattern = PASSES[k]
    text, found, values, heads = F.col("masked"), "__m", "__v", "__h"
    rows = rows.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).withColumn(values, F.regexp_extract_all(text, F.lit(pattern), F.lit(2))).withColumn(heads, F.regexp_extract_all(text, F.lit(pattern), F.lit(1)))
    ok = (lambda v: valid_tckn(v)) if k == CHECKED else (lambda v: F.lit(True))
    plain = (lambda v: F.replace(v, F.lit(" "), F.lit(""))) if kind == "IBAN" else (lambda v: v)
    marks = F.transform(F.arrays_zip(values, heads), lambda p, i: F.concat(p["__h"], F.when(ok(p["__v"]), F.concat(F.lit(OPEN), F.lit(f"{k}:"), i.cast("string"), F.lit(CLOSE))).otherwise(p["__v"])))
    hits = F.filter(F.transform(values, lambda v, i: F.when(ok(v), F.struct(F.lit(kind).alias("pii_type"), plain(v).alias("value"), F.lit(k).alias("pass"), i.cast("int").alias("pos")))), lambda h: h.isNotNull())
    # pieces between the matches alternate with the marks
    pieces = F.split(text, pattern, -1)
    joined = F.array_join(F.zip_with(pieces, F.concat(marks, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    some = F.size(found) > 0
    return rows.withColumn("hits", F.when(some, F.concat("hits", hits)).otherwise(F.col("hits"))).withColumn("masked", F.when(some, joined).otherwise(text)).drop(found, values, heads)


def detect(docs: DataFrame, text: str = "raw_text") -> DataFrame:
    """docs with masked (marks instead of values) and hits (pii_type, value, pass, pos)."""
    plain = F.coalesce(F.col(text), F.lit(""))
    escaped = plain
    for sign, sequence in ESCAPED.items():
        escaped = F.replace(escaped, F.lit(sign), F.lit(sequence))
    rows = docs.withColumn("masked", F.when(plain.rlike(f"[{OPEN}-{ESCAPE}]"), escaped).otherwise(plain)).withColumn("hits", F.array().cast("array<struct<pii_type:string,value:string,pass:int,pos:int>>"))
    for k in range(len(PASSES)):
        rows = _pass(rows, k)
    return rows


def exploded(detected: DataFrame, *columns: Column | str) -> DataFrame:
    """columns, h: a row for each hit.

    The outer form, as of the other Spark derives a filter on the array and pushes it down
    through the passes, writing each pass's expressions into the next's.
    """
    return detected.select(*columns, F.explode_outer("hits").alias("h")).filter("h is not null")


def vault(detected: DataFrame, known: DataFrame | None = None, seq: str = "ingest_seq", save=saved) -> DataFrame:
    """pii_type, value, placeholder, first_seq, first_pass, first_pos of every distinct value.

    Values are numbered by type in the order of document, pass and place; values first seen at
    one place of a repeated document number by value; known values keep their placeholder. The
    distinct values are dealt by ranges of that order, so no task numbers all of a type.
    """
    first = exploded(detected, F.col(seq).alias("seq")).groupBy("h.pii_type", "h.value").agg(F.min(F.struct("seq", "h.pass", "h.pos")).alias("first"))
    if known is not None:
        first = first.join(known.select("pii_type", "value"), ["pii_type", "value"], "left_anti")
    placed = relational.numbered(first, ["pii_type", "first", "value"], save)
    starts = placed.groupBy("pii_type").agg((F.min("number") - 1).alias("start"))  # a row a type, as of the next
    if known is not None:
        starts = starts.join(known.groupBy("pii_type").agg(F.count(F.lit(1)).alias("had")), "pii_type", "left").withColumn("start", F.col("start") - F.coalesce("had", F.lit(0))).drop("had")
    number = (F.col("number") - F.col("start")).cast("string")
    new = placed.join(F.broadcast(starts), "pii_type").select(
        "pii_type", "value", F.concat(F.lit("["), F.col("pii_type"), F.lit("_"), number, F.lit("]")).alias("placeholder"),
        F.col("first.seq").alias("first_seq"), F.col("first.pass").alias("first_pass"), F.col("first.pos").alias("first_pos"),
    )
    return new if known is None else known.unionByName(new)


def redact(detected: DataFrame, vault: DataFrame, key: str = "document_id") -> DataFrame:
    """key, text with every mark replaced by its value's placeholder: joins the hits, not the texts, with the vault.

    A row is known by a digest of its marks and hits, so rows may repeat a key, with the same or other texts.
    """
    rows = detected.withColumn("__row", F.sha2(F.to_json(F.struct("masked", "hits")), 256))
    own = exploded(rows, "__row").select("__row", F.col("h.pii_type").alias("pii_type"), F.col("h.value").alias("value"), F.concat_ws(":", "h.pass", "h.pos").alias("mark")).distinct()
    named = own.join(vault.select("pii_type", "value", "placeholder"), ["pii_type", "value"])
    names = named.groupBy("__row").agg(F.map_from_entries(F.collect_list(F.struct("mark", "placeholder"))).alias("names"))
    parts = F.split(F.col("masked"), f"[{OPEN}{CLOSE}]", -1)
    marked = F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.try_element_at(F.col("names"), p)).otherwise(p)), "")
    text = F.when(F.col("names").isNull(), F.col("masked")).otherwise(marked)
    plain = text
    for sign, sequence in reversed(ESCAPED.items()):
        plain = F.replace(plain, F.lit(sequence), F.lit(sign))
    return rows.join(names, "__row", "left").select(key, F.when(F.contains(text, F.lit(ESCAPE)), plain).otherwise(text).alias("text"))


def audit(vault: DataFrame, timestamp: Column | None = None, save=saved) -> DataFrame:
    """One event for each new value, without the value, in the order of first sight."""
    placed = relational.numbered(vault, ["first_seq", "first_pass", "first_pos", "placeholder"], save, "seq")
    return placed.select(F.col("seq").cast("long").alias("seq"), F.lit("REDACT").alias("action"), "pii_type", "placeholder", (F.lit("") if timestamp is None else timestamp).alias("timestamp"))
