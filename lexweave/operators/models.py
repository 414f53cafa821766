"""Ports to a language model: prompts of entities and relations, answers in Arrow batches, the memo."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexweave.functions.text_tr import entity_key
from lexweave.operators import entities, relational

# Fixed texts of the prompts.
_ENTITIES = (
    "Aşağıdaki METİN'de geçen önemli VARLIKLARI çıkar: kişiler, şirketler/kurumlar, projeler ve yerler. Kurallar:\n"
    "- Her varlığı AYRI SATIRA yaz, başka hiçbir açıklama ekleme.\n"
    "- Sadece METİN'de GEÇEN adları yaz; hiçbir şey UYDURMA.\n"
    "- Sıradan kelimeleri (fiil, bağlaç, cümle başı kelimesi) YAZMA.\n\n"
    "METİN: "
)
_RELATIONS = (
    "Aşağıdaki METİN'de, verilen VARLIKLAR arasındaki ilişkileri çıkar.\nHer satıra bir ilişki yaz, tam olarak şu biçimde:\nVARLIK1 | ilişki | VARLIK2\n\nKurallar:\n"
    "- İlişki kısmı KISA bir fiil öbeği olsun (en fazla 3 kelime): 'anlaştı', 'teknik destek verdi', 'raporu hazırladı'.\n"
    "- Yalnızca METİN'de AÇIKÇA belirtilen ilişkileri yaz; hiçbir şey UYDURMA.\n"
    "- Yalnızca VARLIKLAR listesindeki adları kullan.\n"
    "- İlişki yoksa hiçbir şey yazma.\n\n"
    "VARLIKLAR: "
)


def entity_prompt(text: Column) -> Column:
    return F.concat(F.lit(_ENTITIES), text, F.lit("\n\nVARLIKLAR:"))


def relation_prompt(names: Column, text: Column) -> Column:
    return F.concat(F.lit(_RELATIONS), F.array_join(names, ", "), F.lit("\n\nMETİN: "), text, F.lit("\n\nİLİŞKİLER:"))


def completed(prompts: DataFrame, complete: Callable[[str], str]) -> DataFrame:
    """L1: key, answer of prompts (key, prompt): the port is called once a row, in the executors' Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = [complete(p) for p in batch.column("prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(answers, pa.string())], ["key", "answer"])

    return prompts.select("key", "prompt").mapInArrow(run, "key string, answer string")


def embedded(texts: DataFrame, embed: Callable[[list[str]], list[list[float]]], key: str = "chunk_id") -> DataFrame:
    """L2: key, embedding of texts (key, text): the port gets a batch of texts at a time."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = embed(batch.column("text").to_pylist()) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(vectors, pa.list_(pa.float64()))], [key, "embedding"])

    return texts.select(key, "text").mapInArrow(run, f"{key} {kind}, embedding array<double>")


def prompt_key(prompt: Column) -> Column:
    return F.concat(F.lit("complete:"), F.sha2(prompt, 256))


def answered(asked: DataFrame, memo: DataFrame, complete: Callable[[str], str], save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """L3: (asked with key and answer, new rows of the memo) of asked, which has a column prompt.

    Each distinct prompt that the memo lacks is asked once; answers are saved before they are
    used, so that no second use asks again.
    """
    keyed = asked.withColumn("key", prompt_key(F.col("prompt")))
    missing = keyed.groupBy("key").agg(F.first("prompt").alias("prompt")).join(memo.select("key"), "key", "left_anti")
    new = save(completed(missing, complete))
    return relational.memoised(keyed, memo, new), new


def entities_of(docs: DataFrame, memo: DataFrame, complete: Callable[[str], str], save: Callable[[DataFrame], DataFrame], text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(docs with names, new rows of the memo): what the model names in each text, one prompt a document."""
    asked, new = answered(docs.withColumn("prompt", entity_prompt(F.col(text))), memo, complete, save)
    return asked.withColumn("names", entities.parse_entities(F.col("answer"))).drop("prompt", "key", "answer"), new


def relations_of(docs: DataFrame, memo: DataFrame, complete: Callable[[str], str], save: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(document_id, source, target, relation, rel_seq; new rows of the memo) of docs (document_id, text, labels).

    source and target are node ids, as graph.cooccurrences needs them. Documents of fewer than
    two labels aren't asked of the model.
    """
    wanted = docs.filter(F.size("labels") >= 2)
    asked, new = answered(wanted.withColumn("prompt", relation_prompt(F.col("labels"), F.col("text"))), memo, complete, save)
    found = asked.select("document_id", F.posexplode(entities.parse_relations(F.col("answer"), F.col("labels"), entity_key)).alias("rel_seq", "r"))
    return found.select("document_id", entity_key(F.col("r.source")).alias("source"), entity_key(F.col("r.target")).alias("target"), F.col("r.relation").alias("relation"), "rel_seq"), new
