"""Quality rules that judge lines first: failing lines are removed, and a text that loses too much is rejected."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lexweave.llm.common import map_batches, texts

SYMBOLS = re.compile(r"[#*$%&|<>]")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: Lines that many pages share. Fixed values.
BOILERPLATE = re.compile(
    r"all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings)|accept (?:all )?cookies|licensed under|subscribe to|sign up|log in|click here"
    r"|read more|share (?:this|on)|enable javascript|powered by|follow us|tous droits réservés|alle rechte vorbehalten|todos los derechos reservados",
    re.IGNORECASE,
)
ENDS = (".", "!", "?", "…", ":", ";", '"', "'", "”", "»", ")", "]")
#: A line of menu entries: so many separators between short entries.
MENU = re.compile(r"\s[|»›•·>]\s")
#: A line fails beyond these shares: of signs among its characters, of words in capitals, of words that end in the same sign run.
MAX_SYMBOLS, MAX_CAPITALS, MAX_BANGS = 0.08, 0.6, 0.4
#: A line fails if boilerplate phrases are at least this share of its characters; less of them is part of its prose.
MIN_BOILERPLATE = 0.06
#: A text is rejected if its lines lose more than this share of its characters in words.
MAX_LOST = 0.5


def line_fails(line: str, words: list[str]) -> str:
    """The first rule that the line fails, or nothing."""
    n = len(words)
    phrases = sum(map(len, BOILERPLATE.findall(line)))
    if phrases and phrases >= MIN_BOILERPLATE * len(line):
        return "boilerplate"
    if len(MENU.findall(line)) >= max(3, n // 8):
        return "navigation"
    if len(SYMBOLS.findall(line)) > MAX_SYMBOLS * len(line):
        return "symbols"
    if n >= 8 and sum(map(str.isupper, words)) > MAX_CAPITALS * n:
        return "capitals"
    if n >= 8 and sum(w.endswith("!!") for w in words) > MAX_BANGS * n:
        return "punctuation"
    if n >= 30 and not any(c in line for c in ".!?,;:"):
        return "punctuation"
    if n >= 4 and n < 12 and not words[-1].endswith(ENDS) and sum(w[:1].isupper() for w in words) >= 0.8 * n:
        return "navigation"
    return ""


def repeated_words(words: list[str]) -> int:
    """Words within windows of five that occur twice or more; exact, as words and windows are numbered."""
    if len(words) < 6:
        return 0
    numbers: dict[str, int] = {}
    ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    if len(numbers) == len(words):
        return 0

    def join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        _, named = np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)
        return named

    two = join(ids[:-1], ids[1:])
    four = join(two[:-2], two[2:])
    five = join(four[:-1], ids[4:])
    again = np.bincount(five)[five] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, np.flatnonzero(again), 1)
    np.add.at(covered, np.flatnonzero(again) + 5, -1)
    return int((np.cumsum(covered[:-1]) > 0).sum())


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned text)."""
    words = WORDS.findall(text)
    n, chars = len(words), sum(map(len, words))
    seen: set[str] = set()
    dup, lost, clean = 0, 0, []
    for line in text.split("\n"):
        own = WORDS.findall(line)
        if own:
            again = line in seen
            seen.add(line)
            dup += again
            if again or line_fails(line, own):
                lost += sum(map(len, own))
                continue
        clean.append(line)
    repeat = repeated_words(words)
    failed = n < 10 or 100 * repeat > 20 * n
    return n, chars, len(SYMBOLS.findall(text)), dup, repeat, failed, not failed and lost <= MAX_LOST * chars, "\n".join(clean)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, clean_text string"


def assess(docs: DataFrame, clean: bool = True) -> DataFrame:
    """One row a document: counts, verdicts, and the text without its failing lines.

    A map over partitions. Null counts as an empty text, which fails (no words); repeated rows
    are judged each; an empty table gives no rows; other columns are ignored; a very long text is
    judged whole. clean: whether the text is made and returned.
    """

    schema = SCHEMA.split(", ")[: None if clean else -1]

    def run(batches):
        kinds = [*[pa.int64()] * 5, *[pa.bool_()] * 2, *[pa.string()] * clean]
        names = [c.split()[0] for c in schema]
        for batch in batches:
            if batch.num_rows:
                columns = [*zip(*map(judge, texts(batch)), strict=True)][: len(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return map_batches(docs.select("doc_id", "text"), run, ", ".join(schema))
