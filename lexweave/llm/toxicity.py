"""Toxicity by subword bags: averaged n-gram embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of the embeddings of its character n-grams (and of itself, as one of them), a
window of WINDOW words the mean of its words, and a linear softmax over that mean gives the
window's class. (The softmax is linear, so no longer window can be worse than its worst word:
one word is the window that decides.) Embeddings begin small and random and are trained together with the softmax, in
all their dimensions; in training some words are misspelled at random in either class, so that
the n-grams that are left of a word must do, and a misspelling that training never saw shares
them. A text is as toxic as its worst window, so one insult counts alike in short and long texts;
every window of the whole text is scored. In training the windows of a toxic text that count are
those that the model so far finds worst; at first, those of the words that toxic texts hold most
often against clean ones.
"""

from __future__ import annotations

import itertools
import math
import re
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import crc32_of, gathered, give_back, map_batches, passing_tables, shared_table, words_of

WINDOW, STRIDE = 1, 1
BUCKETS, WIDTH, GRAMS, COMMON = 1 << 18, 8, (3, 5), 3
#: The bound of the labelled sample that the model is fitted on: texts, taken in the order of a hash of doc_id.
MAX_TRAINING = 4000
#: The bound of what the sample sends to the driver: bytes of words that are numbered, text by text.
MAX_SAMPLE_BYTES = 64 << 20
THRESHOLD = 0.7
#: Of the words of a training window, the share that is misspelled.
MISSPELLED = 0.6
#: In toxic texts, windows of so much evidence count in training besides the worst: a text may hold several insults.
EVIDENCE = 2.0
MAX_WORDS, MAX_WORD_BYTES = 300_000, 64
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def core(word: str) -> str:
    """The word in lower case without signs at its ends."""
    return _EDGE.sub("", word.lower())


def grams(core: str) -> list[int]:
    """Buckets of a word's n-grams, and of the word itself, a very long word's all; and COMMON times the
    bucket that all words share, so that one n-gram alone doesn't decide a short word."""
    if not core:
        return [0]
    marked = f"<{core}>".encode()
    low, high = GRAMS
    return [*[0] * COMMON, 1 + zlib.crc32(marked) % (BUCKETS - 1), *(1 + zlib.crc32(marked[i : i + n]) % (BUCKETS - 1) for n in range(low, high + 1) for i in range(len(marked) - n + 1))]


def misspelled(core: str, random: np.random.Generator) -> str:
    """The word with a letter doubled, dropped, replaced or swapped with the next; a word of three letters or fewer stays."""
    if len(core) < 4:
        return core
    k, way = int(random.integers(0, len(core))), int(random.integers(0, 4))
    if way == 0:
        return core[: k + 1] + core[k:]
    if way == 1:
        return core[:k] + core[k + 1 :]
    if way == 2:
        return core[:k] + chr(97 + int(random.integers(0, 26))) + core[k + 1 :]
    k = min(k, len(core) - 2)
    return core[:k] + core[k + 1] + core[k] + core[k + 2 :]


def windows(n: int) -> np.ndarray:
    """Where the windows of n words begin; the last ends at the text's end."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    starts = np.arange(0, n - WINDOW, STRIDE)
    return np.append(starts, n - WINDOW)


@dataclass
class Model:
    """weight: what each bucket adds to the log odds of a word; slope and shift calibrate the worst window's."""

    weight: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0


class Scorer(dict):
    """core of a word -> its share of the log odds; scores texts, a batch at a time."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, core_: str) -> float:
        own = grams(core_)
        odds = float(self.model.weight[own].sum() / len(own))
        if len(core_) <= MAX_WORD_BYTES:
            self[core_] = odds
        return odds

    def worst(self, texts: pa.Array) -> np.ndarray:
        """The highest log odds among each text's windows; a text without words has the bias alone."""
        if len(self) > MAX_WORDS:
            self.clear()
        distinct, numbers, ends = words_of(texts)
        cores = _CORES.sub("", "\n".join(distinct.cast(pa.large_string()).to_pylist()).lower()).split("\n") if len(distinct) else []
        odds = np.fromiter(map(self.__getitem__, cores), float, len(cores))[numbers]
        sums = np.concatenate([[0.0], np.cumsum(odds)])
        begin, end = ends[:-1], ends[1:]
        last = np.repeat(end, np.maximum(0, end - begin))  # of each word, where its text ends
        at = np.arange(len(odds))
        window = np.where(at + WINDOW <= last, (sums[np.minimum(at + WINDOW, len(odds))] - sums[at]) / WINDOW, -np.inf)
        out = np.zeros(len(begin))
        short = end - begin < WINDOW
        out[short] = (sums[end[short]] - sums[begin[short]]) / np.maximum(1, (end - begin)[short])
        if not short.all():  # windows across a text's end are -inf, so a sweep from begin to begin takes in no other text's
            out[~short] = np.maximum.reduceat(window, begin[~short])
        return out + self.model.bias

    def score(self, texts: pa.Array) -> np.ndarray:
        z = self.model.slope * self.worst(texts) + self.model.shift
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


#: As _EDGE, for words a line each.
_CORES = re.compile(r"(?m)^(?:[^\w\n]|_)+|(?:[^\w\n]|_)+$")


class _Trainer:
    """Distinct words of the sample with their buckets; texts as arrays of word numbers."""

    def __init__(self, cores: list[str], texts: list[np.ndarray]):
        self.cores, self.texts = cores, texts
        # one packed array, filled word by word: lists of all words' buckets would take the driver ten times the memory
        flat, size = array("i"), array("i")
        for word in cores:
            own = grams(word)
            flat.extend(own)
            size.append(len(own))
        self.size, self.flat = np.array(size, np.int64), np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)
        self.first = np.cumsum(self.size) - self.size

    def odds(self, weight: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weight[self.flat], self.first) / self.size

    def evidence(self, chosen: np.ndarray, toxic: np.ndarray) -> np.ndarray:
        """For each word the log ratio of its shares of toxic and of clean texts, drawn to 0 where it is rare."""
        seen = np.zeros((2, len(self.cores)))
        for i in chosen:
            seen[int(toxic[i]), np.unique(self.texts[i])] += 1
        many = np.array([max(1, (~toxic[chosen]).sum()), max(1, toxic[chosen].sum())])
        drawn = 4 * many / many.sum()  # four texts' worth of the average
        return np.log((seen[1] + drawn[1]) / many[1]) - np.log((seen[0] + drawn[0]) / many[0])

    def fit(self, chosen: np.ndarray, toxic: np.ndarray, rounds: int = 4, steps: int = 200, batch: int = 256, rate: float = 0.3, decay: float = 1e-5) -> Model:
        """Joint training by Adagrad; the sums of squares begin at 0.01, so that rare n-grams take small steps."""
        random = np.random.default_rng(7)
        embedding = random.normal(0, 0.1 / math.sqrt(WIDTH), (BUCKETS, WIDTH)).astype(np.float32)
        softmax, bias = random.normal(0, 1 / math.sqrt(WIDTH), (2, WIDTH)), np.zeros(2)
        squares, own_squares = np.full((BUCKETS, WIDTH), 0.01, np.float32), np.full((2, WIDTH + 1), 1.0)
        begins = {i: windows(len(self.texts[i])) for i in chosen}
        bad, good = [i for i in chosen if toxic[i]], [i for i in chosen if not toxic[i]]
        if not bad or not good:
            return Model(np.zeros(BUCKETS, np.float32), 3.0 if bad else -3.0)
        odds = evidence = self.evidence(chosen, toxic)

        def of_windows(i: int, of_word: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0.0], np.cumsum(of_word[self.texts[i]])])
            return (sums[np.minimum(begins[i] + WINDOW, len(self.texts[i]))] - sums[begins[i]]) / WINDOW

        clear = [(i, b) for i in bad for b in begins[i][of_windows(i, evidence) >= EVIDENCE]]

        def buckets(word: int) -> np.ndarray:
            if random.random() < MISSPELLED:
                return np.array(grams(misspelled(self.cores[word], random)), np.int32)
            return self.flat[self.first[word] : self.first[word] + self.size[word]]

        for _ in range(rounds):
            worst = {i: begins[i][np.argsort(-of_windows(i, odds), kind="stable")[:2]] for i in chosen}
            positive = clear + [(i, worst[i][0]) for i in bad]
            negative = [(i, b) for i in good for b in [*worst[i], *random.choice(begins[i], min(4, len(begins[i])), replace=False)]]
            for _ in range(steps):
                some = [positive[k] for k in random.integers(0, len(positive), batch // 2)] + [negative[k] for k in random.integers(0, len(negative), batch // 2)]
                target = np.repeat([1, 0], batch // 2)
                bags = [[buckets(w) for w in self.texts[i][b : b + WINDOW].tolist()] for i, b in some]
                words = [w for bag in bags for w in bag]
                own, size = np.concatenate(words), np.fromiter(map(len, words), np.int64, len(words))
                long = np.fromiter(map(len, bags), np.int64, len(bags))
                weight = np.repeat(1 / (size * np.repeat(long, long)), size)  # of each n-gram in its window's mean
                first = np.cumsum(np.add.reduceat(size, np.cumsum(long) - long)) - np.add.reduceat(size, np.cumsum(long) - long)
                hidden = np.add.reduceat(embedding[own] * weight[:, None], first, axis=0)
                z = hidden @ softmax.T + bias
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(batch), target] -= 1
                down = (p @ softmax)[np.repeat(np.arange(batch), np.diff(np.append(first, len(own))))] * weight[:, None]
                hit, back = np.unique(own, return_inverse=True)
                pull = np.stack([np.bincount(back, down[:, k], len(hit)) for k in range(WIDTH)], axis=1)
                own_pull = np.concatenate([p.T @ hidden, p.sum(axis=0)[:, None]], axis=1) / batch
                own_squares += own_pull**2
                step = 0.3 * own_pull / np.sqrt(own_squares)
                softmax, bias = softmax - step[:, :-1], bias - step[:, -1]
                squares[hit] += pull**2
                embedding[hit] -= rate * pull / np.sqrt(squares[hit])
            embedding *= 1 - decay * steps
            odds = self.odds(embedding @ (softmax[1] - softmax[0]).astype(np.float32))
        return Model((embedding @ (softmax[1] - softmax[0])).astype(np.float32), float(bias[1] - bias[0]))


def calibrated(model: Model, worst: np.ndarray, toxic: np.ndarray) -> Model:
    """Logistic calibration of the worst window's log odds on a fold that the model hasn't seen.

    Damped Newton steps on standardised odds, with a weak prior on the slope, so that a fold
    that happens to be separable doesn't make a step function of the score.
    """
    centre, spread = float(np.mean(worst)), float(np.std(worst)) or 1.0
    x = np.stack([(worst - centre) / spread, np.ones(len(worst))], axis=1)
    y, w, prior = toxic.astype(float), np.array([1.0, 0.0]), np.array([0.3, 1e-3])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-4)[:, None]).T @ x + np.diag(prior)
        step = np.linalg.solve(h, x.T @ (p - y) + prior * (w - [1.0, 0.0]))
        w = w - step * min(1.0, 0.5 / max(1e-9, float(np.abs(step).max())))
    slope = max(float(w[0]), 0.05) / spread
    return Model(model.weight, model.bias, slope, float(w[1]) - slope * centre)


def fit(rows: list[tuple[str, bool]]) -> Model:
    """Fits on all rows; calibrates with the model of two thirds of them on the rest. Without rows: never toxic."""
    if not rows:
        return Model(np.zeros(BUCKETS, np.float32), -3.0)
    toxic, texts = np.array([bool(t) for _, t in rows]), pa.array([t for t, _ in rows], pa.string())
    distinct, numbers, ends = words_of(texts)
    known: dict[str, int] = {"": 0}
    of_word = np.array([known.setdefault(core(w.decode("utf-8")), len(known)) for w in distinct.to_pylist()] or [0], np.int32)
    nothing = np.zeros(1, np.int32)
    trainer = _Trainer(list(known), [of_word[numbers[b:e]] if e > b else nothing for b, e in itertools.pairwise(ends.tolist())])
    all_, third = np.arange(len(rows)), np.arange(len(rows)) % 3 == 0
    worst = Scorer(trainer.fit(all_[~third], toxic)).worst(texts.filter(pa.array(third)))
    model = calibrated(trainer.fit(all_, toxic), worst, toxic[third])
    del trainer, known, of_word, numbers, distinct, texts
    give_back()
    return model


def training_rows(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING, most_bytes: int = MAX_SAMPLE_BYTES) -> list[tuple[str, bool]]:
    """(text, toxic) of labelled rows that training may see: whole texts in the order of a hash of
    doc_id, at most limit of them and, leaving out what would exceed it, most_bytes in all.

    Rows held out: crc32(doc_id as text) mod 3 is 1. Labels without doc_id or toxic are left out;
    of labels that repeat a doc_id the highest counts, of texts that do the one with the smallest
    hash. Empty tables give no rows; other columns are ignored. The sample is bounded, so it is
    broadcast, and its texts collected.
    """
    seen = labels.filter("doc_id is not null and toxic is not null").filter(crc32_of(F.col("doc_id")) % 3 != 1)
    sample = seen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(sample), "doc_id")
    found = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    with passing_tables(docs.sparkSession):
        found = shared_table(found.withColumns({"bytes": F.octet_length("text"), "place": F.xxhash64("doc_id")}), "toxicity-sample")
        taken, room = [], most_bytes
        for r in sorted(found.select("place", "doc_id", "bytes").collect()):
            if r["bytes"] <= room:
                taken.append(r["doc_id"])
                room -= r["bytes"]
        rows = found.filter(F.col("doc_id").isin(taken)).select("doc_id", "text", "toxic").collect()
    return [(r["text"], r["toxic"] == 1) for r in sorted(rows, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))]


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text: a map over partitions.

    Null and empty texts get the bias's score; repeated rows are scored each; an empty table gives
    no rows; other columns are ignored; a very long text is scored in all its windows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in gathered(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scorer.score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that score below the threshold; one pass, no join. Cases as of score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        scorer = Scorer(sent.value)
        for batch in gathered(batches):
            yield batch.filter(pa.array(scorer.score(batch.column("text")) < threshold, pa.bool_()))

    return map_batches(docs, run, docs.schema)
