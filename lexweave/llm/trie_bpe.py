"""BPE encoding of a batch of distinct pieces over one trie.

A piece's byte-pair encoding is fixed, prefix by prefix, by the last token of each prefix: the
last token of a prefix is the one vocabulary entry t that ends it, is its own encoding, and
may follow the last token of what precedes t (the two, encoded together, stay the two). So the
pieces are put into a trie of symbols, and one depth-first walk gives every node its last token
from its ancestors' - a prefix that many pieces share is encoded once. The symbol that ends a
piece carries the vocabulary's end-of-word mark and is a symbol of its own. The vocabulary
entries that end a prefix come from a suffix automaton over the entries, one step a node.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from lexweave.llm.common import map_batches, resident, texts, tokenizer_path
from lexweave.llm.wordcache import LETTERS, PIECES, PLAIN, pack, spelled

#: Bounds of a worker's memory: nodes of a trie before it is walked and dropped; words, pieces and pairs kept.
MAX_NODES, MAX_KEPT = 300_000, 450_000
#: Bytes of the longest word whose ids are kept.
MAX_WORD_BYTES = 128
_PLAIN = re.compile(PLAIN)


class Merges:
    """The vocabulary file's merges, with the two questions that the walk asks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {pair: k for k, pair in enumerate(pairs)}
        self._own: dict[int, bool] = {}
        self._follows: dict[int, bool] = {}

    def symbols(self, token: str) -> list[str]:
        if self.end and token.endswith(self.end) and len(token) > len(self.end):
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return list(token)

    def merged(self, symbols: list[str]) -> list[str]:
        """Plain byte-pair encoding: the lowest-ranked pair first, leftmost of equals."""
        none = len(self.rank)
        while len(symbols) > 1:
            ranks = [self.rank.get(pair, none) for pair in zip(symbols, symbols[1:], strict=False)]
            if (best := min(ranks)) == none:
                break
            at = ranks.index(best)
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def own(self, t: int) -> bool:
        """Whether the token is its own encoding."""
        if (known := self._own.get(t)) is None:
            known = self._own[t] = self.merged(self.symbols(self.tokens[t])) == [self.tokens[t]]
        return known

    def follows(self, a: int, b: int) -> bool:
        """Whether b may follow a within a piece."""
        if (known := self._follows.get(key := a << 32 | b)) is None:
            if len(self._follows) > MAX_KEPT:
                self._follows.clear()
            x, y = self.tokens[a], self.tokens[b]
            known = self._follows[key] = self.merged([*self.symbols(x), *self.symbols(y)]) == [x, y]
        return known


class Endings:
    """Automaton over symbols: its state after a prefix names the tokens that end the prefix."""

    def __init__(self, merges: Merges):
        self.merges = merges
        letters = LETTERS.values()
        self.number = {s: k for k, s in enumerate([*letters, *(c + merges.end for c in letters if merges.end)])}
        self.wide = len(self.number)
        self.goto: dict[int, int] = {}
        self.token, self.back, up, depth = [-1], [0], [(0, 0)], [0]
        for token, t in merges.ids.items():
            state, symbols = 0, [self.number.get(s) for s in merges.symbols(token)]
            if None in symbols:  # no piece can hold it
                continue
            for s in symbols:
                below = self.goto.get(state * self.wide + s)
                if below is None:
                    below = self.goto[state * self.wide + s] = len(up)
                    up.append((state, s)), depth.append(depth[state] + 1), self.token.append(-1), self.back.append(0)
                state = below
            self.token[state] = t
        self.depth = depth
        for state in sorted(range(1, len(up)), key=depth.__getitem__):
            parent, s = up[state]
            if parent:
                self.back[state] = self.step(self.back[parent], s)
        self._ends: dict[int, tuple[tuple[int, int], ...]] = {}

    def step(self, state: int, symbol: int) -> int:
        while (below := self.goto.get(state * self.wide + symbol)) is None:
            if not state:
                return 0
            state = self.back[state]
        return below

    def ends(self, state: int) -> tuple[tuple[int, int], ...]:
        """(token, its symbols) of the state, longest first, those that are their own encoding."""
        if (known := self._ends.get(state)) is None:
            found, at = [], state
            while at:
                if self.token[at] >= 0 and self.merges.own(self.token[at]):
                    found.append((self.token[at], self.depth[at]))
                at = self.back[at]
            known = self._ends[state] = tuple(found)
        return known


class Trie:
    """Nodes are dicts from a symbol to the node below; the edge of an ending symbol leads to the piece."""

    def __init__(self, endings: Endings):
        self.endings, self.root, self.nodes = endings, {}, 0
        self.ending = {c: endings.number[c + endings.merges.end] for c in LETTERS.values()}

    def insert(self, piece: str) -> None:
        node, number = self.root, self.endings.number
        for c in piece[:-1]:
            below = node.get(s := number[c])
            if below is None:
                below = node[s] = {}
                self.nodes += 1
            node = below
        node[self.ending[piece[-1]]] = piece

    def walk(self) -> Iterator[tuple[str, bytes]]:
        """(piece, packed ids) of every piece, depth first."""
        endings, merges = self.endings, self.endings.merges
        goto, ends, wide = endings.goto.get, endings._ends.get, endings.wide
        known = merges._follows.get
        last: list[int] = []  # for each prefix of the path, its last token
        begin: list[int] = []  # and where that begins
        stack = [(iter(self.root.items()), 0)]
        while stack:
            below_of, state = stack[-1]
            n = len(last) + 1
            for symbol, below in below_of:
                now = goto(state * wide + symbol)
                if now is None:
                    now = endings.step(state, symbol)
                for t, long in ends(now) or endings.ends(now):
                    at = n - long
                    if not at:
                        break
                    a = last[at - 1]
                    ok = known(a << 32 | t)
                    if ok or ok is None and merges.follows(a, t):
                        break
                else:
                    raise ValueError("no token ends a prefix: the vocabulary lacks a byte")
                if type(below) is dict:
                    last.append(t), begin.append(at)
                    stack.append((iter(below.items()), now))
                    break
                ids = [t]
                while at:
                    ids.append(last[at - 1])
                    at = begin[at - 1]
                ids.reverse()
                yield below, pack(ids)
            else:
                stack.pop()
                if stack:
                    last.pop(), begin.pop()


class TrieEncoder:
    """Encodes and decodes whole texts, a batch at a time, as the tokenizers library does."""

    def __init__(self, path: str):
        self.endings = Endings(Merges(path))
        self.library = Tokenizer.from_file(path)  # for the normal form and the cut into pieces alone
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.tokens = self.endings.merges.tokens | {i: t for t, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.pieces: dict[str, bytes] = {}
        self.ids: dict[bytes, bytes] = {}

    def pieces_of(self, word: str) -> list[str | int]:
        """The word's pieces in byte letters; a special token as its id."""
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return list(map(spelled, PIECES.findall(word.lower())))
        found: list[str | int] = []
        for part in self.cut.split(word):
            if part in self.special:
                found.append(self.special[part])
            elif part:
                plain = self.library.normalizer.normalize_str(part)
                found += [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(plain) if p]
        return found

    def learn(self, pieces: set[str]) -> None:
        """The encodings of the pieces, each shared prefix once."""
        trie = Trie(self.endings)
        for piece in pieces:
            trie.insert(piece)
            if trie.nodes > MAX_NODES:
                self.pieces.update(trie.walk())
                trie = Trie(self.endings)
        self.pieces.update(trie.walk())

    def batch(self, rows: list[str]) -> list[tuple[bytes, str]]:
        """(ids packed as little-endian unsigned 32-bit integers, decoded text) of each text."""
        split = [t.encode("utf-8").split() for t in rows]
        if len(self.ids) > MAX_KEPT:
            self.ids.clear()
        if len(self.pieces) > MAX_KEPT:
            self.pieces.clear()
        new = {w: self.pieces_of(w.decode("utf-8")) for w in set().union(*split) - self.ids.keys()}
        self.learn({p for ps in new.values() for p in ps if isinstance(p, str)} - self.pieces.keys())
        for word, pieces in new.items():
            self.ids[word] = b"".join([pack([p]) if isinstance(p, int) else self.pieces[p] for p in pieces])
        packed = [b"".join(map(self.ids.__getitem__, words)) for words in split]
        for word in new:
            if len(word) > MAX_WORD_BYTES:
                del self.ids[word]
        return [(ids, self.decode(ids)) for ids in packed]

    def decode(self, packed: bytes) -> str:
        """The text of the ids; this vocabulary names no decoder, so tokens are joined by a space."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def encoder(path: str) -> TrieEncoder:
    """The worker's encoder for the vocabulary file."""
    return resident(("trie", path), lambda: TrieEncoder(path))


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded string of every whole text.

    A map over partitions, without a shuffle. Null and empty texts give empty ids and an empty
    decoded text; rows that repeat are encoded each; other columns of docs are ignored.
    """
    path = path or tokenizer_path()

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            done = encoder(path).batch(texts(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([i for i, _ in done], pa.binary()), pa.array([d for _, d in done], pa.string())],
                ["doc_id", "ids", "decoded"],
            )

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, ids binary, decoded string")
