"""Entities and relations: regex names, parsers of model replies, the filter, grounding."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text_tr import FOLD_FROM, FOLD_TO, UPPER, fold, lower_tr, name_windows, words

# What makes a candidate no named entity.
MONTHS = ("ocak", "şubat", "mart", "nisan", "mayıs", "haziran", "temmuz", "ağustos", "eylül", "ekim", "kasım", "aralık")
ADDRESS = ("mahallesi", "mahalle", "caddesi", "cadde", "sokak", "sokağı", "bulvarı", "bulvar", "apartmanı", "sitesi", "plaza", "blok", "daire", "kat", "no:", "posta kodu")
GREETING = ("sayın", "saygılarımızla", "saygılarımla", "değerli", "ilgili makama")
GENERAL_LAST = (
    "analizi", "planı", "modeli", "takvimi", "raporu", "departmanı", "müdürlüğü", "müdürlük", "kurulu", "salonu", "projeleri", "projesi", "toplantısı", "sözleşmesi", "notu", "özeti", "hizmetleri", "süreci",
    "tutanağı", "yazışması", "maddesi", "bölümü", "listesi", "faaliyetleri", "birimi", "biriminin", "ekibi", "komitesi",
)
GENERAL_FIRST = ("genel", "sayın", "ilgili", "değerli", "tüm", "ilgili makam")
PLACES = ("türkiye", "turkiye", "türkiye cumhuriyeti", "istanbul", "ankara", "izmir", "avrupa", "asya", "amerika", "almanya", "ingiltere", "fransa", "türk", "t.c.", "tc")
IDENTITY = ("tckn", "vkn", "iban", "kimlik", "vergi", "sicil", "numarası", "numara", "no", "nolu")
GENERAL_ALONE = ("müşteri", "musteri", "taraf", "taraflar", "şirket", "firma", "kurum", "sözleşme", "belge", "rapor", "proje", "yüklenici", "tedarikçi", "personel", "çalışan", "birim")
MAX_WORDS, MAX_RELATION_WORDS, SIMILAR = 5, 4, 0.82

_TABLE = str.maketrans(FOLD_FROM, FOLD_TO)


def regex_names(x: Column) -> Column:
    """Distinct runs of capitalised words, in order of first sight."""
    word = r"[A-ZĞÜŞİÖÇ][\wğüşıöç]+"
    return F.array_distinct(F.regexp_extract_all(x, F.lit(rf"(?U)\b({word}(?:\s+{word})*)\b"), F.lit(1)))


def trimmed(x: Column) -> Column:
    return F.btrim(F.btrim(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(",;:.")), F.lit("\"'«»"))


def rejected(x: Column) -> Column:
    """Whether the candidate is no named entity."""
    name = trimmed(x)
    low = lower_tr(name)
    own = words(low)
    first, last = F.try_element_at(own, F.lit(1)), F.try_element_at(own, F.lit(-1))
    among = lambda w, values: F.coalesce(w.isin(*values), F.lit(False))
    folded = lambda values: [v.translate(_TABLE) for v in values]
    shape = (
        name.rlike(r"^\[?[A-Z]+_\d+\]?$") | name.rlike(r"^\d{11}$") | name.rlike(r"(?i)^TR[\s\d]{10,}$")
        | name.rlike(rf"^[{UPPER}]{{2,}}[-/][{UPPER}0-9]+([-/][{UPPER}0-9]+)*$") | name.rlike(r"^[\d\s.,:/()-]+$")
    )
    return (
        (F.length(name) < 2) | shape | F.contains(name, F.lit(":")) | F.exists(own, lambda w: w.rlike(r"^\d{6,}$")) | F.exists(own, lambda w: w.isin(*IDENTITY)) | (F.size(own) > MAX_WORDS)
        | among(first, GREETING + GENERAL_FIRST) | F.translate(low, FOLD_FROM, FOLD_TO).isin(*folded(PLACES)) | F.exists(own, lambda w: w.isin(*ADDRESS, *MONTHS)) | among(last, GENERAL_LAST)
        | ((F.size(own) == 1) & F.translate(low, FOLD_FROM, FOLD_TO).isin(*folded(GENERAL_ALONE))) | ~name.rlike(r"\p{L}")
    )


#: What ends a line.
_LINE_END = r"\r\n|[\n\r\x0b\f\x1c-\x1e\u0085  ]"


def parse_entities(reply: Column) -> Column:
    """The names in a model's reply, one a line, without bullets and numbers."""
    lines = F.transform(F.split(F.coalesce(reply, F.lit("")), _LINE_END), lambda s: F.regexp_replace(F.regexp_replace(s, r"(?U)^\s+|\s+$", ""), r"(?U)^[-•*·]*\s*(?:[\d.)]\s*)*", ""))
    return F.array_distinct(F.filter(lines, lambda s: s != ""))


def parse_relations(reply: Column, entities: Column, key) -> Column:
    """(source, relation, target) of well-formed lines whose ends are two of the entities, in their spelling."""
    strip = lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    keys = F.transform(entities, key)

    def spelling(name: Column) -> Column:
        """The last entity with the name's key."""
        own = key(name)
        return F.try_element_at(F.filter(entities, lambda e: key(e) == own), F.lit(-1))

    parts = F.filter(F.transform(F.split(F.coalesce(reply, F.lit("")), _LINE_END), lambda s: F.transform(F.split(s, r"\|"), strip)), lambda p: F.size(p) == 3)
    ok = lambda p: F.size(words(p[1])).between(1, MAX_RELATION_WORDS) & F.array_contains(keys, key(p[0])) & F.array_contains(keys, key(p[2])) & (key(p[0]) != key(p[2]))
    found = F.transform(F.filter(parts, ok), lambda p: F.struct(spelling(p[0]).alias("source"), p[1].alias("relation"), spelling(p[2]).alias("target")))
    return F.when(F.size(entities) >= 2, found).otherwise(F.slice(found, 1, 0))


def grounded_exactly(name: Column, source: Column) -> Column:
    """T10 without the near match: the source's spelling where the folded name occurs in it, else null."""
    a, b = fold(name), fold(source)
    at = F.call_function("instr", b, a)
    steady = (F.length(a) == F.length(name)) & (F.length(b) == F.length(source))
    filled = (F.length(name) > 0) & (F.length(source) > 0)
    return F.when(~filled, None).when(~steady, name).when(at > 0, F.substring(source, at, F.length(name)))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """row, near: of the windows the one most similar to the name, compared by their folds."""
    for batch in batches:
        near = []
        for a, own, low in zip(*(batch.column(c).to_pylist() for c in ("fold", "windows", "folds")), strict=True):
            ratios = [SequenceMatcher(None, a, f).ratio() for f in low or ()]
            best = max(ratios, default=0.0)
            near.append(own[ratios.index(best)] if best >= SIMILAR else None)
        yield pa.RecordBatch.from_arrays([batch.column("name"), batch.column("windows"), pa.array(near, pa.string())], ["name", "windows", "near"])


def ground(rows: DataFrame, name: str, source: str, out: str = "spelling") -> DataFrame:
    """Adds the source's spelling of the name, or null: exact where possible (JVM-side), else the
    most similar run of capitalised words (Arrow). Only distinct names and windows that match nowhere
    exactly go to Python; texts never do."""
    names = unused(rows.columns, "exact", "windows", "name", "near")
    exact, windows, key, near = map(F.col, names)
    rows = rows.withColumn(names[0], grounded_exactly(F.col(name), F.col(source)))
    rows = rows.withColumns({names[1]: F.when(exact.isNull() & (F.length(name) > 0), name_windows(F.col(source))), names[2]: F.col(name)})
    left = rows.filter(windows.isNotNull()).select(key.alias("name"), windows.alias("windows")).distinct()
    asked = left.withColumns({"fold": fold(F.col("name")), "folds": F.transform("windows", fold)})
    found = asked.mapInArrow(_nearest, "name string, windows array<string>, near string").select(F.col("name").alias(names[2]), F.col("windows").alias(names[1]), F.col("near").alias(names[3]))
    return rows.join(found, [names[2], names[1]], "left").withColumn(out, F.coalesce(exact, near)).select(*[F.col(f"`{c}`") for c in rows.columns if c not in names and c != out], out)


def unused(columns: list[str], *names: str) -> list[str]:
    """The names, with underscores before them until no column is called so."""
    taken = {c.lower() for c in columns}
    found = []
    for name in names:
        while name in taken:
            name = f"_{name}"
        taken.add(name)
        found.append(name)
    return found
