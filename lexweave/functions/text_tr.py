"""Turkish text scalars as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that compare as one, company suffixes, and how similar a name must be to be the same.
FOLD_FROM, FOLD_TO = "ışğüöçâî", "isguocai"
COMPANY_SUFFIXES = ("a.ş.", "a.ş", "aş", "a.s.", "as", "ltd.", "ltd", "şti.", "şti", "limited", "şirketi", "anonim", "inc.", "inc", "llc", "gmbh", "co.", "corp.")
UPPER = "A-ZÇĞİÖŞÜ"

#: What Python's split() takes for white space, as a Java pattern.
SPACE = r"(?U)[\s\x1c-\x1f]+"


def lower_tr(x: Column) -> Column:
    """T1."""
    return F.lower(F.translate(x, "Iİ", "ıi"))


def words(x: Column) -> Column:
    return F.filter(F.split(x, SPACE), lambda w: w != "")


def canonical_key(x: Column) -> Column:
    """T2."""
    return F.array_join(words(lower_tr(x)), " ")


def strip_company_suffix(x: Column) -> Column:
    """Without trailing company suffixes; a name of suffixes alone stays as it is, trimmed."""
    own = words(x)
    suffix = lambda w: F.btrim(lower_tr(w), F.lit(",;:")).isin(*COMPANY_SUFFIXES)
    marks = F.transform(own, lambda w, i: F.when(suffix(w), 0).otherwise(i + 1))
    keep = F.coalesce(F.array_max(marks), F.lit(0))
    return F.when(keep > 0, F.array_join(F.slice(own, F.lit(1), F.greatest(keep, F.lit(1))), " ")).otherwise(F.regexp_replace(x, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""))


def fold(x: Column) -> Column:
    """T8."""
    return F.translate(lower_tr(x), FOLD_FROM, FOLD_TO)


def entity_key(x: Column) -> Column:
    """T4."""
    return F.translate(canonical_key(strip_company_suffix(x)), FOLD_FROM, FOLD_TO)


def title_tr(x: Column) -> Column:
    """T5: each word's first letter upper, by Turkish rules, the rest lower."""
    one = lambda w: F.concat(F.upper(F.translate(F.left(w, F.lit(1)), "iı", "İI")), F.substring(w, F.lit(2), F.length(w)))
    return F.array_join(F.transform(words(lower_tr(x)), one), " ")


def is_upper(x: Column) -> Column:
    return (x == F.upper(x)) & (x != F.lower(x))


def display_label(x: Column) -> Column:
    """T6."""
    name = strip_company_suffix(x)
    return F.when(is_upper(name) & (F.size(words(name)) > 1), title_tr(name)).otherwise(name)


def preference(label: Column, seq: Column) -> Column:
    """Of several labels the one with the smallest preference is shown."""
    return F.struct(is_upper(label).alias("upper"), F.length(label).alias("length"), seq.alias("seq"))


def name_windows(x: Column) -> Column:
    """Runs of up to five capitalised words, and every run of words within each."""
    word = rf"[{UPPER}][\wçğıöşüÇĞİÖŞÜ.]*"
    runs = F.regexp_extract_all(x, F.lit(rf"(?U){word}(?:\s+{word}){{0,4}}"), F.lit(0))

    def inner(run: Column) -> Column:
        own = F.regexp_extract_all(run, F.lit(r"(?U)\S+"), F.lit(0))
        gaps = F.concat(F.regexp_extract_all(run, F.lit(r"(?U)\s+"), F.lit(0)), F.array(F.lit("")))
        spaced = F.zip_with(own, gaps, lambda w, g: F.concat(w, g))
        n = F.size(own)
        span = lambda i, j: F.concat(F.array_join(F.slice(spaced, i, j - i), ""), F.element_at(own, j))
        return F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: span(i, j))))

    return F.flatten(F.transform(runs, inner))
