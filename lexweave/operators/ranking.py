"""Vectors (V1-V3), BM25 (K1-K4), reciprocal rank fusion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions.text_tr import lower_tr, words

K1, B, EPSILON = 1.5, 0.75, 0.25


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def normalised(v: Column) -> Column:
    """V1; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n == 0, x.cast("double")).otherwise(x.cast("double") / F.when(n == 0, 1.0).otherwise(n)))


def cosine_top(rows: DataFrame, query: list[float], k: int, vector: str = "embedding", order: str = "seq") -> DataFrame:
    """V2, V3: the k rows most like the query; the query is a literal, so this is a scan and a top-k."""
    length = sum(x * x for x in query) ** 0.5 or 1.0
    unit = F.array(*[F.lit(float(x) / length) for x in query])
    wide = F.when(F.size(vector) != len(query), F.raise_error(F.lit("vectors of different dimension"))).otherwise(F.col(vector))
    dot = F.aggregate(F.zip_with(normalised(wide), unit, lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return rows.withColumn("score", dot).orderBy(F.desc("score"), order).limit(k)


def terms(text: Column) -> Column:
    """K1: a text's terms in order."""
    return words(lower_tr(F.coalesce(text, F.lit(""))))


def postings(chunks: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """K1, K2: key, term, tf, len."""
    listed = chunks.select(key, terms(F.col(text)).alias("terms"))
    return listed.select(key, F.size("terms").alias("len"), F.explode("terms").alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"), F.first("len").alias("len"))


def statistics(chunks: DataFrame, text: str = "text") -> DataFrame:
    """K2: term, df, size of every term; the empty term, which no text has, stands for all chunks: their number, and their terms.

    One pass: each chunk's distinct terms, counted map-side before they are shuffled. Rows of
    several tables add up by term, so the archive stores them as they come.
    """
    listed = chunks.select(terms(F.col(text)).alias("terms"))
    own = F.concat(F.array(F.struct(F.lit("").alias("term"), F.size("terms").cast("long").alias("size"))), F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("long").alias("size"))))
    return listed.select(F.explode(own).alias("t")).groupBy("t.term").agg(F.count(F.lit(1)).alias("df"), F.sum("t.size").alias("size"))


def bm25_score(query: str, stats: DataFrame, text: str = "text") -> Column:
    """K3: the score of a text; what doesn't depend on it (a row a term of the query, one of means) is read here.

    The mean of all terms' idf stands in, times EPSILON, for negative ones.
    """
    spark = stats.sparkSession
    asked = [r["t"] for r in spark.createDataFrame([(query,)], "q string").select(F.explode(terms(F.col("q"))).alias("t")).collect()]
    summed = stats.groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size"))
    all_ = summed.filter("term = ''").first()
    if all_ is None or not asked:
        return F.lit(0.0)
    n, mean_len = float(all_["df"]), all_["size"] / all_["df"]
    idf = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    own = summed.filter("term <> ''").select("term", idf.alias("idf"))
    mean = own.agg(F.avg("idf")).first()[0]
    of = {r["term"]: r["idf"] if r["idf"] >= 0 else EPSILON * mean for r in own.filter(F.col("term").isin(asked)).collect()}
    hits, long = F.filter(terms(F.col(text)), lambda t: t.isin(list(of) or [""])), F.size(terms(F.col(text)))

    def part(term: str) -> Column:
        tf = F.size(F.filter(hits, lambda t: t == term))
        return F.lit(asked.count(term) * of[term]) * tf * (K1 + 1) / (tf + K1 * (1 - B + B * long / mean_len))

    return sum((part(t) for t in dict.fromkeys(asked) if t in of), F.lit(0.0))


def bm25(chunks: DataFrame, query: str, text: str = "text", stats: DataFrame | None = None) -> DataFrame:
    """chunks with a score (of that name, whatever they had); those without a query term score 0. A projection: no shuffle."""
    return chunks.withColumn("score", bm25_score(query, statistics(chunks, text) if stats is None else stats, text))


def bm25_top(chunks: DataFrame, query: str, k: int, text: str = "text", order: str = "seq", stats: DataFrame | None = None) -> DataFrame:
    return bm25(chunks, query, text, stats).orderBy(F.desc("score"), order).limit(k)


def fuse(rankings: list[DataFrame], k: int = 60) -> DataFrame:
    """id, rrf, first of rankings (id, rank from 1); ties by first appearance."""
    rows = None
    for n, r in enumerate(rankings):
        one = r.select("id", "rank", F.lit(n).alias("list"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"), F.min(F.struct("list", "rank")).alias("first")).orderBy(F.desc("rrf"), "first")


def ranked(top: DataFrame, key: str, order: str) -> DataFrame:
    """id, rank of an already cut top-k (so one partition holds few rows)."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), order))).select(F.col(key).alias("id"), "rank")


def context(fused: DataFrame, chunks: DataFrame, key: str = "chunk_id", k: int = 3) -> DataFrame:
    """one row, the k first texts joined by an empty line, in their order."""
    first = fused.limit(k).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rrf"), "first"))).join(chunks, fused["id"] == chunks[key])
    return first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), "\n\n").alias("context"))


def prompt(context_text: Column, question: Column) -> Column:
    """L4: the template of a question; fixed text."""
    head = (
        "Aşağıdaki BAĞLAM'a dayanarak soruyu yanıtla. SADECE bağlamda verilen bilgiyi kullan; bağlamda olmayan hiçbir şeyi UYDURMA. "
        "Bağlamda cevap yoksa 'Bu bilgi arşivde bulunamadı' de.\n\nBAĞLAM: "
    )
    return F.concat(F.lit(head), context_text, F.lit("\n\nSORU: "), question, F.lit("\n\nCEVAP:"))
