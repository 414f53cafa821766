"""Near-duplicates by MinHash bands, sequential Bayesian pruning and exact verification.

1. Every text becomes its set of 5-word shingles (64-bit hashes), BANDS x ROWS minima of it and
   a key of the set. Texts with the same set are one node, named by their smallest doc_id.
2. Nodes with the same minima in a band share a bucket. A bucket first pairs each member with
   its most central one only (a star): the one whose buckets hold the most members. Near copies
   of one text so meet the same member in most of their buckets, the one most alike to the rest:
   a few pairs a text, not one a bucket, and few that don't link.
3. A pair's signatures are compared a batch of minima at a time; the pair is dropped as soon as
   the posterior probability of a similarity of the threshold falls below MISS.
4. Survivors are verified on their full sets. Links make components.
5. In STARS further rounds, each bucket that still holds several components pairs its members
   with the next most central one. Copies of copies, not all of which reach the threshold with
   the first, meet by that, at m - 1 pairs a bucket at most.
6. Members of buckets that hold several components even then are compared across components
   over their rarest shingles: two sets of n and m shingles that reach the threshold have so
   many in common that one lies among the first few of both, whatever the order; rarest first
   keeps passages that many texts share out of the join. Members of a shingle's largest component
   meet those outside it, never each other; a text outside may still meet every member.

No step emits all pairs of a linked group; nothing is capped. The chance that a pair of exactly the
threshold shares no bucket is (1 - 0.75^4)^32, 5 in a million.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm.common import gathered, map_batches, passing_tables, shared_table, words_of

SHINGLE, PERCENT = 5, 75
BANDS, ROWS = 32, 4
#: Minima compared at a time, and the chance of dropping a pair of the threshold that each batch may add.
BATCH, MISS = 16, 1e-6
#: Rounds of stars around further members.
STARS = 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """Of each whole text the distinct 5-word shingles, hashed and ascending; a shorter text is one, no words none."""
    distinct, numbers, ends = words_of(texts, lower=True)
    hashed = np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, distinct.to_pylist())), "<u8").astype(np.uint64)
    for begin, end in itertools.pairwise(ends.tolist()):
        words = hashed[numbers[begin:end]]
        n = min(SHINGLE, len(words))
        if not n:
            yield words
            continue
        many = len(words) - n + 1
        h = np.full(many, np.uint64(n))
        for k in range(n):
            h = mixed(h * _ODD + words[k : k + many])
        yield np.unique(h)


def shingles(text: str) -> np.ndarray:
    """The set of one text."""
    return next(shingle_sets(pa.array([text], pa.string())))


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(20_260_101)
    return random.integers(1, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), random.integers(0, 2**63, count, np.uint64)


_A, _B = _permutations(BANDS * ROWS)


def minima(hashes: np.ndarray) -> np.ndarray:
    """For each permutation, the smallest upper half of what it makes of the set."""
    best = np.full(len(_A), np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 2048):
        np.minimum(best, (hashes[k : k + 2048, None] * _A + _B).min(axis=0), out=best)
    return best >> np.uint64(32)


def sketched(docs: DataFrame) -> DataFrame:
    """doc_id, n (shingles), set_key, bands (bucket keys), minima (16 bits of each); without text: n 0 and the rest null."""
    turn = mixed(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD)

    def run(batches):
        for batch in gathered(batches):
            n, keys, bands, low = [], [], [], []
            for s in shingle_sets(batch.column("text")):
                n.append(len(s))
                if not len(s):
                    keys.append(None), bands.append(None), low.append(None)
                    continue
                m = minima(s)
                h = turn.copy()
                for column in m.reshape(BANDS, ROWS).T:
                    h = mixed(h * _ODD + column)
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                bands.append(h.view(np.int64)), low.append(m.astype("<u2").tobytes())
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "set_key", "bands", "minima"])

    return map_batches(docs.select("doc_id", "text"), run, "doc_id long, n long, set_key binary, bands array<long>, minima binary")


def fewest_matches(n: int, miss: float = MISS, threshold: float = PERCENT / 100) -> int:
    """The fewest of n matching minima with which P(similarity >= threshold) is miss or more.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), whose tail at t is the chance
    of at most m successes in n + 1 trials of chance t.
    """
    tail = 0.0
    for m in range(n + 1):
        tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if tail >= miss:
            return m
    return n


_LEAST = {n: fewest_matches(n) for n in range(BATCH, BANDS * ROWS + 1, BATCH)}


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two signature matrices survive every batch."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for n, least in _LEAST.items():
        matches += (a[alive, n - BATCH : n] == b[alive, n - BATCH : n]).sum(axis=1)
        on = matches >= least
        alive, matches = alive[on], matches[on]
    return alive


def _pruned(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose signatures don't rule them out."""
    wide = BANDS * ROWS

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, wide) for c in ("x", "y"))
                yield batch.select(["a", "b"]).take(pa.array(likely(x, y)))

    x = nodes.select(F.col("id").alias("a"), F.col("minima").alias("x"))
    y = nodes.select(F.col("id").alias("b"), F.col("minima").alias("y"))
    return map_batches(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y"), run, "a long, b long")


def _full_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """id, set of the nodes (id, set_key, label); written once, as each round reads some of them.

    Of the texts of the labels' doc_id only those with a node's set stay.
    """

    def run(batches):
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([pa.array(map(xxhash.xxh3_128_digest, sets), pa.binary()), pa.array(sets, pa.binary())], ["set_key", "set"])

    read = docs.join(nodes.select("label").distinct(), docs["doc_id"] == F.col("label"), "left_semi").select("doc_id", "text")
    return shared_table(map_batches(read, run, "set_key binary, set binary").join(nodes.select("id", "set_key"), "set_key").dropDuplicates(["set_key"]).select("id", "set"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets reach the threshold."""

    def run(batches):
        for batch in batches:
            keep = []
            for k, (x, y) in enumerate(zip(batch.column("x").to_pylist(), batch.column("y").to_pylist(), strict=True)):
                both = len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True))
                if 100 * both >= PERCENT * ((len(x) + len(y)) // 8 - both):
                    keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int32()))

    x, y = sets.select(F.col("id").alias("a"), F.col("set").alias("x")), sets.select(F.col("id").alias("b"), F.col("set").alias("y"))
    return map_batches(pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y"), run, "a long, b long")


def links_of(pairs: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    return shared_table(_verified(shared_table(_pruned(pairs, nodes), "likely"), sets), "links")


def components(links: DataFrame) -> DataFrame:
    """id, component (smallest id reachable) of every id in links (a, b).

    Each round takes the smallest label among the neighbours, then follows the label's own label;
    it is written to the shared folder, and the rounds end when no label changes. Rounds grow with
    the logarithm of a component's longest shortest path.
    """
    edges = shared_table(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = shared_table(edges.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"]).select("id", "component", F.least("component", "near").alias("low"))
        up = labels.select(F.col("id").alias("low"), F.col("component").alias("up"))
        after = shared_table(lower.join(up, "low").select("id", F.least("low", "up").alias("component"), (F.least("low", "up") < F.col("component")).alias("changed")), "labels")
        labels = after.select("id", "component")
        if after.filter("changed").isEmpty():
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """id, component after more links: only the components that these bring together are worked on."""
    ends = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    all_ = shared_table(labels.unionByName(ends.join(labels, "id", "left_anti").select("id", F.col("id").alias("component"))), "labels")
    of = lambda end: all_.select(F.col("id").alias(end), F.col("component").alias(f"of_{end}"))
    met = links.join(of("a"), "a").join(of("b"), "b").filter("of_a <> of_b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
    up = components(met).select(F.col("id").alias("component"), F.col("component").alias("up"))
    return shared_table(all_.join(up, "component", "left").select("id", F.coalesce("up", "component").alias("component")), "labels")


def _rarest(sets: DataFrame, apart: DataFrame) -> DataFrame:
    """Pairs (a, b) of the ids (id, component, n) in different components that share one of their rarest shingles."""

    def run(batches):
        for batch in batches:
            ids, sets = batch.column("id").to_pylist(), [np.frombuffer(s, np.int64) for s in batch.column("set").to_pylist()]
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), [len(s) for s in sets])), pa.array(np.concatenate(sets))], ["id", "shingle"])

    rows = map_batches(sets.join(apart.select("id"), "id", "left_semi"), run, "id long, shingle long")
    common = rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    # a shingle of one text alone joins nothing but takes its place in the order, before all others
    ordered = rows.join(common, "shingle", "left").withColumn("place", F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("df", F.lit(1)), "shingle")))
    first = ordered.filter("df is not null").join(apart, "id").filter(F.col("place") <= F.col("n") - F.ceil(PERCENT * F.col("n") / 100) + 1).select("shingle", "id", "component", "n", "place")
    first = shared_table(first, "first")
    parts = first.groupBy("shingle", "component").agg(F.count(F.lit(1)).alias("many"))
    several = parts.groupBy("shingle").agg(F.max(F.struct("many", "component"))["component"].alias("largest"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    met = shared_table(first.join(shared_table(several.select("shingle", "largest"), "several").hint("merge"), "shingle"), "met")
    # of two sets of n and m shingles, at least `both` must be common, so one lies among the first n - both + 1 and m - both + 1
    both = F.ceil(PERCENT * (F.col("na") + F.col("nb")) / (100 + PERCENT))
    x, y = ([F.col(c).alias(c[0] + side) for c in ("component", "n", "place")] for side in "ab")
    outside = met.filter("component <> largest").select("shingle", F.col("id").alias("a"), *x)
    pairs = outside.join(met.select("shingle", "largest", F.col("id").alias("b"), *y), "shingle")
    early = (F.col("pa") <= F.col("na") - both + 1) & (F.col("pb") <= F.col("nb") - both + 1)
    once = (F.col("cb") == F.col("largest")) | (F.col("a") < F.col("b"))
    return pairs.filter(once & (F.col("ca") != F.col("cb")) & _sizes_allow(F.col("na"), F.col("nb")) & early).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _most_central(members: DataFrame) -> DataFrame:
    """key, hub (weight, id, component, n) of each bucket."""
    return shared_table(members.groupBy("key").agg(F.max(F.struct("weight", "id", "component", "n")).alias("hub")), "hubs")


def _star(members: DataFrame, hubs: DataFrame) -> DataFrame:
    """Pairs (a, b) of the buckets' hubs with the members of other components."""
    met = members.join(hubs.hint("merge"), "key").filter(F.col("component") != F.col("hub.component")).filter(_sizes_allow(F.col("n"), F.col("hub.n")))
    return met.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()


def _sizes_allow(n, m):
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _apart(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The members of buckets that hold several components, with their component."""
    placed = shared_table(members.join(labels, "id", "left").select("key", "id", "n", "weight", F.coalesce("component", "id").alias("component")), "placed")
    several = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high").select("key")
    return shared_table(placed.join(shared_table(several, "several").hint("merge"), "key"), "apart")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row.

    Null and empty texts, and texts without words, have no set: they are kept, linked with
    nothing. Every distinct set is a node of its own; those of rows that repeat a doc_id are
    linked. A null doc_id is its own component (null) and kept. An empty table gives no rows.
    Other columns of docs are ignored. The result is written to the shared folder; the tables on
    the way to it are removed.

    What is joined by a bucket's key is written before: a join of two read tables has nothing
    that binds a key to one task, so that Spark splits a bucket that holds very many. These tables
    grow with the input, so they are merged, not broadcast, at every size.
    """
    with passing_tables(docs.sparkSession) as keep:
        found = shared_table(_components_of(docs), "near-duplicates")
        keep(found)
    return found


def _components_of(docs: DataFrame) -> DataFrame:
    sketches = shared_table(sketched(docs), "sketches")
    filled = sketches.filter("n > 0 and doc_id is not null")
    # numbered once and written; any row of the set has the set's minima and bands
    of_set = filled.groupBy("set_key").agg(F.min("doc_id").alias("label"), F.first("n").alias("n"), F.first("minima").alias("minima"), F.first("bands").alias("bands"))
    nodes = shared_table(of_set.withColumn("id", F.monotonically_increasing_id()), "nodes")
    same = nodes.select("id", "set_key", "label")
    rows = nodes.select("id", "n", F.explode("bands").alias("key"))
    shared = shared_table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"), "shared")
    members = shared_table(rows.join(shared.hint("merge"), "key"), "members")
    members = shared_table(members.join(members.groupBy("id").agg(F.sum("size").alias("weight")), "id").select("key", "id", "n", "weight"), "weighed")
    sets = _full_sets(docs, same.join(members.select("id").distinct(), "id", "left_semi"))
    alone = members.withColumn("component", F.col("id"))
    hubs = _most_central(alone)
    labels = components(links_of(_star(alone, hubs), nodes, sets))
    for _ in range(STARS):
        left = _apart(members, labels)
        before = hubs.select("key", F.struct("hub.weight", "hub.id").alias("before"))
        hubs = _most_central(left.join(before.hint("merge"), "key").filter(F.struct("weight", "id") < F.col("before")))
        labels = joined(labels, links_of(_star(left, hubs), nodes, sets))
    left = _apart(members, labels)
    rest = _rarest(sets, left.select("id", "component", "n").distinct()).distinct()
    labels = joined(labels, links_of(rest, nodes, sets))
    # sets of one doc_id, then texts of one set
    own = shared_table(filled.join(same, "set_key").select("doc_id", "id").distinct(), "own")
    repeated = own.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).filter("a <> last").select("doc_id", "a")
    labels = joined(labels, shared_table(own.join(repeated, "doc_id").filter("id <> a").select("a", F.col("id").alias("b")), "repeated"))
    placed = shared_table(same.join(labels, "id", "left").select("set_key", "label", F.coalesce("component", "id").alias("component")), "placed")
    smallest = shared_table(placed.groupBy("component").agg(F.min("label").alias("component_id")), "smallest")
    same = placed.join(smallest, "component").select("set_key", "component_id")
    found = sketches.select("doc_id", "n", "set_key").join(same, "set_key", "left")
    component = F.when(F.col("n") > 0, F.least("component_id", "doc_id")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(component)
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def deduplicate(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which each component keeps its smallest doc_id."""
    dropped = near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*[f"`{c}`" for c in docs.columns])
