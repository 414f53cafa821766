"""The archive: tables in a folder, and the operations on them.

Every table is a list of Parquet folders. A manifest names the folders of all tables; it is
written last, by a rename to the next number, so that a change of several tables takes place at
once or not at all, and an archive that is opened again is as it was left. New documents add
folders; a table of more than MAX_PARTS of them is written anew as one.
"""

from __future__ import annotations

import datetime
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text_tr import display_label, entity_key, preference
from lexweave.operators import chunking, entities, graph, models, pii_tr, ranking, relational
from lexweave.sources import loaders

_HISTORY = "history array<struct<state:string,note:string>>"
#: The archive's tables (S6). nodes, edges and terms hold what each ingest saw; reading merges them.
SCHEMAS = {
    "catalog": f"document_id string, ingest_seq long, name string, state string, created_at string, {_HISTORY}",
    "chunks": "chunk_id string, document_id string, ord int, seq long, text string, embedding array<double>",
    "terms": "term string, df long, size long",
    "nodes": "node_id string, label string, seq long",
    "edges": "source_id string, target_id string, weight double, confidence double, relation string, seq long, document_id string",
    "node_sources": "node_id string, document_id string",
    "edge_sources": "source_id string, target_id string, document_id string",
    "vault": "pii_type string, value string, placeholder string, first_seq long, first_pass int, first_pos int",
    "audit": "seq long, action string, pii_type string, placeholder string, timestamp string",
    "memo": "key string, answer string",
}
MAX_PARTS = 16


class ArchiveError(Exception):
    """Root of the archive's errors."""


class IngestionError(ArchiveError):
    """A document couldn't be read."""


class InvalidTransition(ArchiveError):
    """A state that mustn't follow."""


class Conflict(ArchiveError):
    """Another writer changed the archive meanwhile; nothing was written."""


def columns_of(name: str) -> list[str]:
    return [c.split()[0] for c in SCHEMAS[name].split(", ")]


@dataclass
class Archive:
    """embed: text column -> vector column; complete: prompt -> answer; names: text column -> array of candidate names.

    by_model: names and relations come from the model (complete must then be picklable), each distinct prompt asked once.
    """

    spark: SparkSession
    path: str
    embed: Callable
    complete: Callable[[str], str]
    names: Callable = entities.regex_names
    by_model: bool = False
    size: int = 500
    overlap: int = 50
    parts: dict[str, list[str]] = field(default_factory=dict, init=False)
    number: int = field(default=0, init=False)

    def __post_init__(self) -> None:
        self.refresh()

    # --- storage -------------------------------------------------------------------------------

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _manifests(self) -> list[int]:
        at, fs = self._fs(f"{self.path}/manifest")
        names = [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def refresh(self) -> None:
        """Takes up the state that was written last, by this or another object."""
        self.number = max(self._manifests(), default=0)
        self.parts = {}
        if self.number:
            text = self.spark.read.text(f"{self.path}/manifest/{self.number}.json", wholetext=True).first()["value"]
            self.parts = json.loads(text)

    def table(self, name: str) -> DataFrame:
        """The table's rows as stored."""
        if not self.parts.get(name):
            return self.spark.createDataFrame([], SCHEMAS[name])
        return self.spark.read.schema(SCHEMAS[name]).parquet(*[f"{self.path}/{p}" for p in self.parts[name]])

    def _save(self, table: DataFrame) -> DataFrame:
        """A passing table."""
        table.write.parquet(path := f"{self.path}/passing/{uuid.uuid4().hex}")
        return self.spark.read.schema(table.schema).parquet(path)

    def _commit(self, add: dict[str, DataFrame] | None = None, replace: dict[str, DataFrame] | None = None) -> None:
        """Writes new parts beside the old, then the manifest: a failed write changes nothing."""
        parts = {name: list(p) for name, p in self.parts.items()}
        written = {}
        for name, rows in {**(add or {}), **(replace or {})}.items():
            own = f"{name}/{uuid.uuid4().hex}"
            if name in (add or {}) and len(parts.get(name, [])) >= MAX_PARTS:
                rows, parts[name] = self.table(name).unionByName(rows.select(columns_of(name))), []
            rows.select(columns_of(name)).write.parquet(f"{self.path}/{own}")
            written[name] = own
        for name, own in written.items():
            parts[name] = [own] if name in (replace or {}) else [*parts.get(name, []), own]
        target, fs = self._fs(f"{self.path}/manifest/{self.number + 1}.json")
        draft, _ = self._fs(f"{self.path}/manifest/{uuid.uuid4().hex}.draft")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
        out.close()
        if fs.exists(target) or not fs.rename(draft, target):
            fs.delete(draft, False)
            raise Conflict("another writer changed the archive; refresh() and try again")
        before = self.parts
        self.parts, self.number = parts, self.number + 1
        self._clean(before)

    def _clean(self, before: dict[str, list[str]]) -> None:
        """Removes passing tables, the manifests before the last two, and parts that neither of these names."""
        kept = {p for own in (before, self.parts) for ps in own.values() for p in ps}
        for number in self._manifests()[:-2]:
            at, fs = self._fs(f"{self.path}/manifest/{number}.json")
            old = json.loads(self.spark.read.text(str(at), wholetext=True).first()["value"])
            for part in {p for ps in old.values() for p in ps} - kept:
                gone, _ = self._fs(f"{self.path}/{part}")
                fs.delete(gone, True)
            fs.delete(at, False)
        at, fs = self._fs(f"{self.path}/passing")
        fs.delete(at, True)

    # --- views ---------------------------------------------------------------------------------

    def nodes(self) -> DataFrame:
        """node_id, the preferred label, its place."""
        best = F.min_by(F.struct("label", "seq"), preference(F.col("label"), F.col("seq")))
        return self.table("nodes").groupBy("node_id").agg(best.alias("n")).select("node_id", "n.label", "n.seq")

    def edges(self) -> DataFrame:
        """Of each directed pair the edge written last."""
        last = F.max_by(F.struct("weight", "confidence", "relation", "seq", "document_id"), F.struct("seq", "document_id"))
        return self.table("edges").groupBy("source_id", "target_id").agg(last.alias("e")).select("source_id", "target_id", "e.*")

    def node(self, name: str) -> str:
        """The label of the node that the name stands for; KeyError where there is none."""
        key = self.spark.createDataFrame([(name,)], "x string").select(entity_key(F.col("x"))).first()[0]
        return graph.node(self.nodes(), key)

    # --- documents -----------------------------------------------------------------------------

    def ingest_files(self, uris: str | list[str], pdf_pages: Callable | None = None, strict: bool = False) -> DataFrame:
        """M2, S5 from files: document_id, name, state of each. A file that can't be read is recorded as
        FAILED, with its error in the history; strict: raises IngestionError besides. A file's id is the
        digest of its uri, so that loading it again replaces it."""
        next_ = (self.table("catalog").agg(F.max("ingest_seq")).first()[0] or 0) + 1
        read = self._save(loaders.load(self.spark, uris, pdf_pages).withColumn("document_id", F.sha2("uri", 256)))
        rows = relational.numbered(read, ["uri"], self._save).withColumn("ingest_seq", F.col("number") + (next_ - 1))
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")
        rows = self._save(rows.select("document_id", "ingest_seq", "uri", "raw_text", "error", F.lit(now).alias("created_at")))
        out = rows.select("document_id", relational.base_name(F.col("uri")).alias("name"), F.when(F.col("error").isNull(), "PARSED").otherwise("FAILED").alias("state")).collect()
        failed = rows.filter("error is not null").select("uri", "error").limit(3).collect() if strict else []
        self.ingest(rows)
        if failed:
            raise IngestionError("; ".join(f"{r['uri']}: {r['error']}" for r in failed))
        return self.spark.createDataFrame(out, "document_id string, name string, state string")

    def ingest(self, documents: DataFrame) -> None:
        """M2 of document_id, ingest_seq, uri, raw_text, created_at and perhaps error: masked before
        anything else is made of the text. Of rows that repeat a document_id the last counts. A
        document that is there already is replaced, and keeps its place."""
        if "error" not in documents.columns:
            documents = documents.withColumn("error", F.lit(None).cast("string"))
        last = F.max_by(F.struct("uri", "raw_text", "created_at", "error"), "ingest_seq")
        all_ = documents.groupBy("document_id").agg(last.alias("d"), F.min("ingest_seq").alias("ingest_seq")).select("document_id", "ingest_seq", "d.*")
        had_place = self.table("catalog").select("document_id", F.col("ingest_seq").alias("had"))
        all_ = self._save(all_.join(had_place, "document_id", "left").withColumn("ingest_seq", F.coalesce("had", "ingest_seq")))
        docs = all_.filter("error is null")
        now = datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")

        found = self._save(pii_tr.detect(docs).drop("raw_text"))
        known = self.table("vault")
        vault = self._save(pii_tr.vault(found, known, save=self._save))
        fresh = self._save(vault.join(known, ["pii_type", "value"], "left_anti"))
        audit = pii_tr.audit(fresh, F.lit(now), self._save).withColumn("seq", F.col("seq") + self.table("audit").count())
        masked = self._save(pii_tr.redact(found, vault).join(found.select("document_id", "ingest_seq"), "document_id"))

        cut = chunking.chunk(masked, self.size, self.overlap).join(masked.select("document_id", "ingest_seq"), "document_id")
        place = lambda pos: F.col("ingest_seq") * (1 << 24) + F.col(pos)
        chunks = self._save(cut.select(F.concat_ws("#", "document_id", "ord").alias("chunk_id"), "document_id", "ord", place("ord").alias("seq"), "text", self.embed(F.col("text")).alias("embedding")))

        memo, asked = self.table("memo"), []
        named = masked.withColumn("names", self.names(F.col("text")))
        if self.by_model:
            named, new = models.entities_of(masked, memo, self.complete, self._save)
            asked.append(new)
        # a name is matched in its document's text once, before the names are put one a row
        exact = named.withColumn("found", F.transform("names", lambda n: F.struct(n.alias("name"), entities.grounded_exactly(n, F.col("text")).alias("exact"))))
        listed = exact.select("document_id", "ingest_seq", F.posexplode("found").alias("pos", "f")).select("document_id", "ingest_seq", "pos", "f.name", "f.exact").filter(~entities.rejected(F.col("name")))
        loose = entities.ground(listed.filter("exact is null").join(masked.select("document_id", "text"), "document_id"), "name", "text")
        spelt = listed.filter("exact is not null").withColumn("spelling", F.col("exact")).unionByName(loose.select(*listed.columns, "spelling")).filter("spelling is not null")
        mentions = self._save(spelt.select("document_id", place("pos").alias("seq"), entity_key(F.col("spelling")).alias("node_id"), display_label(F.col("spelling")).alias("label")))
        relations = None
        if self.by_model:
            labels = mentions.groupBy("document_id").agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("seq", "label"))), lambda s: s["label"])).alias("labels"))
            relations, new = models.relations_of(masked.join(labels, "document_id"), memo, self.complete, self._save)
            asked.append(new)
        edges = self._save(graph.cooccurrences(mentions, relations))

        note = lambda state, text: F.struct(F.lit(state).alias("state"), text.alias("note"))
        begun = note("RECEIVED", F.lit("ingest başladı"))
        counted = mentions.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"))
        parsed = F.concat(F.lit("metin hazır, "), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" varlık çıkarıldı"))
        bad = F.col("error").isNotNull()
        catalog = all_.join(counted, "document_id", "left").select(
            "document_id", "ingest_seq", relational.base_name(F.col("uri")).alias("name"), F.when(bad, "FAILED").otherwise("PARSED").alias("state"), "created_at",
            F.when(bad, F.array(begun, note("PARSING", F.col("error")))).otherwise(F.array(begun, note("PARSING", parsed))).alias("history"),
        )
        add = {
            "vault": fresh, "audit": audit, "chunks": chunks, "terms": ranking.statistics(chunks), "nodes": mentions, "edges": edges, "catalog": catalog,
            "node_sources": graph.provenance(mentions), "edge_sources": edges.select("source_id", "target_id", "document_id").distinct(),
        }
        for new in asked:
            add["memo"] = add["memo"].unionByName(new) if "memo" in add else new
        again = self._save(all_.filter("had is not null").select("document_id"))
        if again.isEmpty():
            self._commit(add=add)
            return
        # What documents had before goes; their graph stays, as an upsert leaves it, and is written over
        old = self.table("chunks")
        gone = ranking.statistics(old.join(again, "document_id", "left_semi")).withColumns({"df": -F.col("df"), "size": -F.col("size")})
        add["terms"] = add["terms"].unionByName(gone)
        replace = {name: relational.without(self.table(name), again).unionByName(add.pop(name).select(columns_of(name))) for name in ("chunks", "catalog")}
        self._commit(add=add, replace=replace)

    def advance(self, document_id: str, target: str, note: str = "") -> None:
        """M1: the document's next state; raises KeyError or InvalidTransition."""
        own = F.col("document_id") == document_id
        row = self.table("catalog").filter(own).first()
        if row is None:
            raise KeyError(document_id)
        if target not in relational.TRANSITIONS[row["state"]]:
            raise InvalidTransition(f"{row['state']} -> {target}")
        step = F.array(F.struct(F.lit(row["state"]).alias("state"), F.lit(note).alias("note")))
        changed = self.table("catalog").withColumns({"history": F.when(own, F.concat("history", step)).otherwise(F.col("history")), "state": F.when(own, target).otherwise(F.col("state"))})
        self._commit(replace={"catalog": changed})

    def delete(self, document_id: str) -> bool:
        """M3: whether it was there. The audit stays."""
        mine = F.col("document_id") == document_id
        if self.table("catalog").filter(mine).isEmpty():
            return False
        n, e, ns, es = graph.delete_document(document_id, self.nodes(), self.edges(), self.table("node_sources"), self.table("edge_sources"))
        gone = ranking.statistics(self.table("chunks").filter(mine)).withColumns({"df": -F.col("df"), "size": -F.col("size")})
        keep = {name: self.table(name).filter(~mine) for name in ("chunks", "catalog")}
        self._commit(add={"terms": gone}, replace={"nodes": n, "edges": e, "node_sources": ns, "edge_sources": es, **keep})
        return True

    def clear(self) -> int:
        """M4: every document of the catalog at once; nodes and edges without any source stay."""
        count = self.table("catalog").count()
        sourced = self.table("node_sources").select("node_id").distinct()
        edges = self.edges().join(self.table("edge_sources").select("source_id", "target_id").distinct(), ["source_id", "target_id"], "left_anti")
        for end in ("source_id", "target_id"):
            edges = edges.join(sourced.withColumnRenamed("node_id", end), end, "left_anti")
        empty = {t: self.spark.createDataFrame([], SCHEMAS[t]) for t in ("chunks", "terms", "catalog", "node_sources", "edge_sources")}
        self._commit(replace={"nodes": self.nodes().join(sourced, "node_id", "left_anti"), "edges": edges, **empty})
        return count

    def reset(self) -> None:
        """All tables empty, provenance too."""
        self._commit(replace={t: self.spark.createDataFrame([], s) for t, s in SCHEMAS.items()})

    # --- questions -----------------------------------------------------------------------------

    def answer(self, question: str, query: list[float]) -> dict:
        """M5: the answer and its sources; an empty archive isn't asked of the model, nor a prompt twice (L3)."""
        chunks = self.table("chunks")
        if chunks.isEmpty():
            return {"answer": "Arşivde bu soruyla ilgili bir şey bulamadım.", "sources": []}
        by_vector = ranking.ranked(ranking.cosine_top(chunks, query, 10), "chunk_id", "seq")
        by_word = ranking.ranked(ranking.bm25_top(chunks, question, 10, stats=self.table("terms")), "chunk_id", "seq")
        fused = ranking.fuse([by_vector, by_word])
        asked = ranking.context(fused, chunks).select(ranking.prompt(F.col("context"), F.lit(question)).alias("prompt")).select("prompt", models.prompt_key(F.col("prompt")).alias("key")).first()
        known = self.table("memo").filter(F.col("key") == asked["key"]).first()
        answer = known["answer"] if known else self.complete(asked["prompt"])
        if not known:
            self._commit(add={"memo": self.spark.createDataFrame([(asked["key"], answer)], SCHEMAS["memo"])})
        ids = fused.limit(3).join(self.table("chunks"), F.col("id") == F.col("chunk_id")).select("chunk_id", "document_id", "text", "rrf", "first")
        sources = relational.source_names(ids, self.table("catalog")).orderBy(F.desc("rrf"), "first").select("chunk_id", "document_id", "name", "text").collect()
        return {"answer": answer, "sources": [r.asDict() for r in sources]}

    def connection(self, source: str, target: str) -> dict:
        """Between the names' nodes."""
        keys = self.spark.createDataFrame([(source, target)], "a string, b string").select(entity_key(F.col("a")), entity_key(F.col("b"))).first()
        path = graph.most_reliable_path(self.edges(), *keys, self._save)
        return graph.described_path(path, self.nodes().select("node_id", "label")).first().asDict()

    def stats(self) -> DataFrame:
        return relational.stats(documents=self.table("catalog"), chunks=self.table("chunks"), nodes=self.nodes(), edges=self.edges(), pii_masked=self.table("audit"))

    def documents(self) -> DataFrame:
        return relational.documents_view(self.table("catalog"))

    def document(self, document_id: str) -> dict:
        """A1: one document's catalog row, with its history; KeyError where there is none."""
        row = self.table("catalog").filter(F.col("document_id") == document_id).first()
        if row is None:
            raise KeyError(document_id)
        return row.asDict(recursive=True)

    def entities(self) -> DataFrame:
        return self.nodes().select("label").orderBy("label")

    def audit_events(self) -> DataFrame:
        return self.table("audit").orderBy(F.desc("seq"))

    def health(self, probe: Callable[[], object] | None = None) -> dict:
        """A3: whether the storage can be written and read just now, and the model answers (probe, or a short prompt)."""

        def up(what: Callable[[], object]) -> bool:
            try:
                what()
                return True
            except Exception:  # whatever is wrong, the answer is no
                return False

        def storage() -> None:
            at, fs = self._fs(f"{self.path}/passing/probe-{uuid.uuid4().hex}")
            fs.create(at, False).close()
            fs.delete(at, False)
            self.table("catalog").limit(1).count()

        return {"status": "ok", "storage": up(storage), "llm": up(probe or (lambda: self.complete("?"))), "persistent": True, "tables": sorted(self.parts)}
