"""Quality scores: random Fourier features of document statistics, ridge regression, isotonic calibration.

The features approximate a Gaussian kernel over the standardised statistics. The normal
equations are summed by partition; each partition sends one fixed-size block, and the sample
that they are summed over is bounded, so a handful of blocks reaches the driver. Scores of a
fold that the ridge weights haven't seen fit a monotone step function (pool adjacent violators).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.llm.common import crc32_of, map_batches, shared_table, texts

FEATURES, RIDGE = 192, 1.0
#: The bound of the labelled sample that the model is fitted on: rows, taken in the order of a hash of doc_id.
MAX_TRAINING = 12_000
_SIGNS, _LETTERS_UP, _DIGITS, _MARKS = re.compile(r"[#*$%&|<>]"), re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[.,;:!?]")


def statistics(text: str) -> list[float]:
    """Statistics of the whole text, each within a fixed range or a logarithm; all 0 for an empty text."""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 17
    lines = [x for x in text.split("\n") if x]
    counts = Counter(words)
    top = counts.most_common(1)[0][1]
    pairs = n - 1
    distinct_pairs = len(set(zip(words, words[1:], strict=False))) if pairs else 1
    letters = sum(map(len, words))
    ups = len(_LETTERS_UP.findall(text))
    return [
        math.log1p(n), math.log1p(letters / n), math.log1p(len(lines)), math.log1p(n / max(1, len(lines))),
        math.sqrt(len(_SIGNS.findall(text)) / chars), math.sqrt(ups / letters), math.sqrt(len(_DIGITS.findall(text)) / chars), math.sqrt(len(_MARKS.findall(text)) / chars),
        math.sqrt(text.count("!") / n), math.sqrt(text.count("|") / n), len(counts) / n, math.sqrt(top / n), distinct_pairs / max(1, pairs),
        1 - len(set(lines)) / max(1, len(lines)), sum(w[-1] in ".!?" for w in words) / n, sum(len(w) <= 3 for w in words) / n, math.log1p(max(map(len, words))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phase: np.ndarray
    weight: np.ndarray
    steps: tuple[np.ndarray, np.ndarray]  # isotonic: raw scores, ascending, and the probability at each

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.waves + self.phase) * math.sqrt(2 / self.waves.shape[1]), z / 8, np.ones((len(x), 1))], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.features(x) @ self.weight, *self.steps), 0, 1)


def pooled(raw: np.ndarray, label: np.ndarray) -> list[tuple[float, float, float, float]]:
    """(sum of labels, sum of raw, count, lowest raw) of the blocks of the non-decreasing fit of label to raw."""
    order = np.argsort(raw, kind="stable")
    blocks: list[tuple[float, float, float, float]] = []
    for x, y in zip(raw[order].tolist(), label[order].tolist(), strict=True):
        blocks.append((y, x, 1.0, x))
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
            (y1, x1, n1, low), (y2, x2, n2, _) = blocks[-2:]
            blocks[-2:] = [(y1 + y2, x1 + x2, n1 + n2, low)]
    return blocks


def isotonic(raw: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The non-decreasing fit of label to raw; blocks are named by their mean raw score."""
    blocks = pooled(raw, label)
    # one pseudo-count of either class keeps the ends off 0 and 1
    return np.array([x / n for _, x, n, _ in blocks]), np.array([(y + 0.5) / (n + 1) for y, _, n, _ in blocks])


def _summed(sample: DataFrame, part) -> np.ndarray:
    """The sum over partitions of part(x, y) over the sample's statistics and labels."""

    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = np.array(batch.column("stats").to_pylist(), float)
                own = part(x, np.array(batch.column("label").to_pylist(), float), np.array(batch.column("fold").to_pylist()))
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()], pa.binary()), pa.array([",".join(map(str, total.shape))], pa.string())], ["sum", "shape"])

    rows = map_batches(sample, run, "sum binary, shape string").collect()
    return sum(np.frombuffer(r["sum"], "<f8").reshape([int(k) for k in r["shape"].split(",")]) for r in rows)


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_TRAINING) -> Model:
    """Fits on at most limit labelled rows that training may see: crc32(doc_id as text) mod 4 isn't 2.

    Labels without doc_id or quality are left out; of labels that repeat a doc_id the lowest
    counts. Without any labelled row the score is 0.5 for every text.
    """
    seen = labels.filter("doc_id is not null and quality is not null").filter(crc32_of(F.col("doc_id")) % 4 != 2)
    chosen = seen.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)

    def run(batches):
        for batch in batches:
            label = [1.0 if q == 1 else 0.0 for q in batch.column("quality").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([statistics(t) for t in texts(batch)], pa.list_(pa.float64())), pa.array(label), batch.column("fold")], ["doc_id", "stats", "label", "fold"])

    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)))
    sample = shared_table(map_batches(rows, run, "doc_id long, stats array<double>, label double, fold long"), "quality")
    wide = len(statistics(""))
    moments = _summed(sample, lambda x, y, f: np.stack([np.full(wide, float(len(x))), x.sum(axis=0), (x * x).sum(axis=0)]))
    random = np.random.default_rng(11)
    waves, phase = random.normal(0, 1 / math.sqrt(wide), (wide, FEATURES)), random.uniform(0, 2 * math.pi, FEATURES)
    if np.ndim(moments) == 0:
        return Model(np.zeros(wide), np.ones(wide), waves, phase, np.zeros(FEATURES + wide + 1), (np.array([0.0]), np.array([0.5])))
    mean = moments[1] / moments[0]
    model = Model(mean, np.sqrt(np.maximum(moments[2] / moments[0] - mean**2, 1e-6)), waves, phase, np.zeros(0), (np.zeros(1), np.zeros(1)))

    def equations(x, y, fold):
        z = np.concatenate([model.features(x), y[:, None]], axis=1)
        return np.stack([z[fold == 0].T @ z[fold == 0], z[fold != 0].T @ z[fold != 0]])

    held, used = _summed(sample, equations)
    solve = lambda m: np.linalg.solve(m[:-1, :-1] + RIDGE * np.eye(len(m) - 1), m[:-1, -1])
    model.weight = solve(used)
    fold = sample.filter("fold = 0").collect()  # a part of the bounded sample
    if fold:
        raw = model.features(np.array([r["stats"] for r in fold])) @ model.weight
        model.steps = isotonic(raw, np.array([r["label"] for r in fold]))
    else:
        model.steps = np.array([0.0, 1.0]), np.array([0.02, 0.98])
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every whole text: a map over partitions. Null and empty texts have all statistics 0."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            x = np.array([statistics(t) for t in texts(batch)], float).reshape(batch.num_rows, -1)
            found = sent.value.score(x) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, score double")
