"""Whole-text encoding by the tokenizers library, remembering the ids of pieces.

The tokenizer drops white space and none of its patterns crosses ASCII white space (neither NFC
nor per-character lower-casing does either), so the ids of a text are the ids of its words in
order, and each distinct word of a batch of texts is encoded once. A word of plain Latin
letters, digits and ASCII signs is cut into the pieces of the vocabulary's own pattern, and each
distinct piece goes through the library's model; any other word (combining marks, other
scripts, special tokens) goes through the whole library.
"""

from __future__ import annotations

import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from lexweave.llm.common import resident, words_of

#: Bounds of the memory: pieces kept (all are forgotten beyond), and letters of the longest kept.
MAX_PIECES, MAX_PIECE = 1_000_000, 128
#: Words whose ids are put in place at a time.
PLACED = 1 << 17

#: Words whose normal form is their lower case, if they hold no special token's "<|".
PLAIN = r"^[\x21-\x7eÀ-ÖØ-öø-ÿ]+$"
#: The vocabulary's pieces, for plain words in lower case, a line each.
PIECES = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9\n]+|\n")
#: Stands for the end of a word among ids; no vocabulary is so large.
END = 0xFFFFFFFF


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


LETTERS = byte_letters()


def pack(ids: list[int]) -> bytes:
    """The ids as little-endian unsigned 32-bit integers."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def spelled(piece: str) -> str:
    """The piece in the vocabulary's byte letters."""
    return piece if piece.isascii() else "".join(map(LETTERS.__getitem__, piece.encode("utf-8")))


class PieceIds(dict):
    """piece or word -> its ids, packed; made by the function given."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, piece: str) -> bytes:
        packed = pack(self.make(piece))
        if len(piece) <= MAX_PIECE:
            self[piece] = packed
        return packed

    def bounded(self) -> PieceIds:
        if len(self) > MAX_PIECES:
            self.clear()
        return self


class WordEncoder:
    """Encodes texts by a vocabulary file; ids are little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        model = self.library.model
        self.pieces = PieceIds(lambda piece: [END] if piece == "\n" else [t.id for t in model.tokenize(spelled(piece))])
        self.others = PieceIds(lambda word: self.library.encode(word, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """The ids of one whole text, packed; an empty text has none."""
        return self.encode_all(pa.array([text]), 0)[0][:-1].tobytes()

    def of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each word's begin, how many each has) of distinct words."""
        words = words.cast(pa.large_string())
        plain = pc.and_not(pc.match_substring_regex(words, PLAIN), pc.match_substring(words, "<|"))
        own = plain.to_numpy(zero_copy_only=False)
        lines = "\n".join(words.filter(plain).to_pylist())
        pieces = self.pieces.bounded()
        flat = np.frombuffer(b"".join(map(pieces.__getitem__, PIECES.findall(lines.lower() + "\n"))), "<u4")
        other = [*map(self.others.bounded().__getitem__, words.filter(pc.invert(plain)).to_pylist())]
        first, size = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if own.any():
            ends = np.flatnonzero(flat == END)
            first[own] = np.concatenate([[0], ends[:-1] + 1])
            size[own] = ends - first[own]
        size[~own] = np.fromiter(map(len, other), np.int64, len(other)) // 4
        first[~own] = len(flat) + np.cumsum(size[~own]) - size[~own]
        return np.concatenate([flat, np.frombuffer(b"".join(other), "<u4")]), first, size

    def encode_all(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, each text's followed by end_id; where each text's end), null as empty.

        A word is looked up once for all texts, and its ids are then put in place by number.
        """
        distinct, numbers, ends = words_of(texts)
        flat, first, size = self.of_words(distinct)
        flat, first, size = np.append(flat, np.uint32(end_id)), np.append(first, len(flat)), np.append(size, 1)
        numbers = np.insert(numbers, ends[1:], len(distinct))
        after = np.cumsum(size[numbers])
        ids = np.empty(int(after[-1]) if len(after) else 0, "<u4")
        for k in range(0, len(numbers), PLACED):
            own = numbers[k : k + PLACED]
            many, begin = size[own], int(after[k - 1]) if k else 0
            shift = first[own] - (after[k : k + PLACED] - many - begin)
            at = np.repeat(shift, many) + np.arange(int(many.sum()))
            ids[begin : begin + len(at)] = flat[at]
        return ids, after[ends[1:] + np.arange(len(ends) - 1)]


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for the vocabulary file."""
    return resident(("words", path), lambda: WordEncoder(path))
