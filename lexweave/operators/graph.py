"""The knowledge graph: nodes, edges, provenance (G1-G8), and the most reliable path."""

from __future__ import annotations

import heapq
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPED, UNTYPED = 0.8, 0.5


def nodes(mentions: DataFrame) -> DataFrame:
    """G1 over mentions (document_id, seq, node_id, label): the preferred label of each node."""
    from lexweave.functions.text_tr import preference

    return mentions.groupBy("node_id").agg(F.min_by("label", preference(F.col("label"), F.col("seq"))).alias("label"))


def provenance(mentions: DataFrame) -> DataFrame:
    return mentions.select("node_id", "document_id").distinct()


def cooccurrences(mentions: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Both directed edges of each pair of a document's nodes, alike in label, confidence and weight.

    relations (document_id, source, target, relation, rel_seq): of one directed pair the last
    counts. The label is that from the earlier node to the later one, else that of the way back;
    of nodes that are mentioned more than once, the last mention decides which is the earlier.
    """
    own = mentions.groupBy("document_id", "node_id").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"))
    side = lambda x: own.select("document_id", *[F.col(c).alias(f"{x}_{c}") for c in ("node_id", "seq", "last")])
    earlier = (F.col("a_last") < F.col("b_last")) | ((F.col("a_last") == F.col("b_last")) & (F.col("a_node_id") < F.col("b_node_id")))
    pairs = side("a").join(side("b"), "document_id").filter(earlier)
    if relations is None:
        pairs = pairs.withColumn("relation", F.lit(""))
    else:
        last = relations.groupBy("document_id", "source", "target").agg(F.max_by("relation", "rel_seq").alias("relation"))
        way = lambda s, t, name: last.select("document_id", F.col("source").alias(s), F.col("target").alias(t), F.nullif("relation", F.lit("")).alias(name))
        for s, t, name in (("a_node_id", "b_node_id", "onward"), ("b_node_id", "a_node_id", "back")):
            pairs = pairs.join(way(s, t, name), ["document_id", s, t], "left")
        pairs = pairs.withColumn("relation", F.coalesce("onward", "back", F.lit("")))
    end = lambda s, t: F.struct(F.col(f"{s}_seq").alias("seq"), F.col(f"{s}_node_id").alias("source_id"), F.col(f"{t}_node_id").alias("target_id"))
    both = pairs.select("document_id", "relation", F.explode(F.array(end("a", "b"), end("b", "a"))).alias("e"))
    confidence = F.when(F.col("relation") != "", TYPED).otherwise(UNTYPED)
    return both.select("document_id", "e.seq", "e.source_id", "e.target_id", confidence.alias("confidence"), (-F.log(confidence)).alias("weight"), "relation")


def node(nodes: DataFrame, node_id: str) -> str:
    """The node's label; raises KeyError for an unknown id."""
    found = nodes.filter(F.col("node_id") == node_id).select("label").first()
    if found is None:
        raise KeyError(node_id)
    return found["label"]


def last_write(edges: DataFrame) -> DataFrame:
    """Of each directed pair the edge that the last document wrote, even where an earlier one was typed."""
    return edges.groupBy("source_id", "target_id").agg(F.max_by(F.struct("weight", "confidence", "relation"), F.struct("seq", "document_id")).alias("e")).select("source_id", "target_id", "e.weight", "e.confidence", "e.relation")


def neighbours(edges: DataFrame, node: str) -> DataFrame:
    return edges.filter(F.col("source_id") == node)


def delete_document(document: str | Column, nodes: DataFrame, edges: DataFrame, node_sources: DataFrame, edge_sources: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, node_sources, edge_sources) without the document.

    A node or edge goes if the document was its only source; an edge also if it touches a node
    that goes. What has no source at all stays.
    """
    mine = F.col("document_id") == document
    left_n, left_e = node_sources.filter(~mine), edge_sources.filter(~mine)
    dead = node_sources.filter(mine).select("node_id").distinct().join(left_n, "node_id", "left_anti")
    dead_edges = edge_sources.filter(mine).select("source_id", "target_id").distinct().join(left_e, ["source_id", "target_id"], "left_anti")

    def alive(e: DataFrame) -> DataFrame:
        e = e.join(dead_edges, ["source_id", "target_id"], "left_anti")
        for end in ("source_id", "target_id"):
            e = e.join(dead.withColumnRenamed("node_id", end), end, "left_anti")
        return e

    return nodes.join(dead, "node_id", "left_anti"), alive(edges), left_n, alive(left_e)


def local_path(rows: list[tuple[str, str, float, str]], source: str, target: str) -> tuple[list[str], float, list[str]] | None:
    """P1 on a small graph: Dijkstra with ties to the smaller (distance, id)."""
    out: dict[str, list[tuple[str, float, str]]] = {}
    known = set()
    for s, t, w, r in rows:
        out.setdefault(s, []).append((t, w, r))
        known |= {s, t}
    if source not in known or target not in known:
        return None
    best, came, queue, done = {source: 0.0}, {}, [(0.0, source)], set()
    while queue:
        d, u = heapq.heappop(queue)
        if u in done:
            continue
        if u == target:
            break
        done.add(u)
        for v, w, r in out.get(u, ()):
            if d + w < best.get(v, math.inf):
                best[v], came[v] = d + w, (u, r)
                heapq.heappush(queue, (d + w, v))
    if target not in best:
        return None
    path, relations = [target], []
    while path[-1] != source:
        u, r = came[path[-1]]
        path.append(u), relations.append(r)
    return path[::-1], best[target], relations[::-1]


def most_reliable_path(edges: DataFrame, source: str, target: str, save, small: int = 200_000) -> DataFrame:
    """One row (nodes, cost, relations), or none. save writes a round's table to shared storage and reads it back.

    A graph of at most `small` edges (counted first) is searched in one task's memory; a larger
    one by relaxing the frontier, a join and an aggregation a round, dropping what already costs
    more than the target does.
    """
    spark = edges.sparkSession
    schema = "nodes array<string>, cost double, relations array<string>"
    rows = edges.select("source_id", "target_id", "weight", "relation")
    if rows.limit(small + 1).count() <= small:
        found = local_path([tuple(r) for r in rows.collect()], source, target)
        return spark.createDataFrame([found] if found else [], schema)
    ends = rows.filter(F.col("source_id").isin(source, target) | F.col("target_id").isin(source, target)).select(F.explode(F.array("source_id", "target_id")).alias("v")).filter(F.col("v").isin(source, target)).distinct()
    if ends.count() < len({source, target}):
        return spark.createDataFrame([], schema)
    reached = save(spark.createDataFrame([(source, 0.0)], "v string, cost double"))
    frontier = reached
    while True:
        limit = reached.filter(F.col("v") == target).agg(F.min("cost")).first()[0]
        step = frontier.filter(F.col("cost") < (math.inf if limit is None else limit)).join(rows, F.col("v") == F.col("source_id")).groupBy("target_id").agg(F.min(F.col("cost") + F.col("weight")).alias("new"))
        better = step.join(reached, F.col("target_id") == F.col("v"), "left").filter(F.col("cost").isNull() | (F.col("new") < F.col("cost"))).select(F.col("target_id").alias("v"), F.col("new").alias("cost"))
        frontier = save(better)
        if frontier.isEmpty():
            break
        reached = save(reached.unionByName(frontier).groupBy("v").agg(F.min("cost").alias("cost")))
    cost = reached.filter(F.col("v") == target).first()
    if cost is None:
        return spark.createDataFrame([], schema)
    # predecessors by the final distances; the way back is as long as the path
    path, relations = [target], []
    while path[-1] != source:
        at = reached.filter(F.col("v") == path[-1]).first()["cost"]
        u = rows.filter(F.col("target_id") == path[-1]).join(reached, F.col("source_id") == F.col("v")).filter(F.col("cost") + F.col("weight") == at).orderBy("cost", "source_id").first()
        path.append(u["source_id"]), relations.append(u["relation"])
    return spark.createDataFrame([(path[::-1], cost["cost"], relations[::-1])], schema)


NOT_FOUND = "Bu iki varlık arasında bilinen bir bağlantı bulunamadı."


def described_path(path: DataFrame, nodes: DataFrame) -> DataFrame:
    """Found, nodes (labels), relations, confidence, message of one path row, or of none."""
    spark = path.sparkSession
    one = path.select(F.posexplode("nodes").alias("pos", "node_id"), "cost", "relations").join(nodes, "node_id", "left")
    own = one.groupBy("cost", "relations").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "node_id").alias("label")))), lambda s: s["label"]).alias("nodes"))
    chance = F.exp(-F.col("cost"))
    hit = own.select(F.lit(True).alias("found"), "nodes", "relations", F.bround(chance, 4).alias("confidence"), F.concat(F.lit("Bağlantı bulundu: "), F.array_join("nodes", " -> "), F.format_string("  (güven: %.2f)", chance)).alias("message"))
    miss = spark.createDataFrame([(False, [], [], 0.0, NOT_FOUND)], hit.schema)
    return hit.unionByName(miss).orderBy(F.desc("found")).limit(1)
