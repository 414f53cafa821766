import random
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from lexweave.operators import chunking, graph, pii_tr, ranking
from lexweave.plans.archive import SCHEMAS, Archive, Conflict, IngestionError, InvalidTransition
from lexweave.sources import loaders
from lexweave.streaming import ingest


def test_chunks_keep_words_and_overlap():
    words = [f"kelime{i}" for i in range(30)]
    chunks = chunking.cut(" ".join(words), 30, 12)
    assert [w for w in dict.fromkeys(w for c in chunks for w in c.split())] == words
    assert all(set(a.split()) & set(b.split()) for a, b in zip(chunks, chunks[1:]))
    assert chunking.cut("", 500, 50) == chunking.cut("  \n ", 500, 50) == []
    assert chunking.cut("x" * 900, 500, 50) == ["x" * 900]


@pytest.mark.parametrize("size,overlap", [(0, 0), (10, 10), (10, -1)])
def test_chunk_parameters(spark, size, overlap):
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame([("a", "b")], "document_id string, text string"), size, overlap)


@pytest.mark.parametrize("tied", [False, True])
def test_path_prefers_reliable_and_both_ways_agree(spark, tied):
    r = random.Random(3)
    weight = (lambda: 0.5) if tied else (lambda: r.uniform(0.1, 2.0))
    rows = [(f"n{a}", f"n{b}", weight(), f"r{a}_{b}") for a in range(12) for b in r.sample(range(12), 3) if a != b]
    edges = spark.createDataFrame(rows, "source_id string, target_id string, weight double, relation string")
    for target in ("n7", "n3") if tied else ("n7",):
        small = graph.most_reliable_path(edges, "n0", target, save=lambda t: t.cache()).collect()
        large = graph.most_reliable_path(edges, "n0", target, save=lambda t: t.cache(), small=0).collect()
        assert [tuple(x) for x in small] == [tuple(x) for x in large]
    assert graph.local_path(rows, "n0", "zzz") is None


def test_pair_has_one_label_both_ways(spark):
    mentions = spark.createDataFrame([("d", 1, "a", "A"), ("d", 2, "b", "B"), ("d", 3, "c", "C"), ("e", 4, "b", "B"), ("e", 5, "a", "A"), ("e", 6, "b", "B")], "document_id string, seq long, node_id string, label string")
    relations = spark.createDataFrame([("d", "a", "b", "sattı", 0), ("d", "b", "a", "ödedi", 1), ("d", "c", "b", "gördü", 2), ("e", "b", "a", "ödedi", 0), ("e", "a", "b", "sattı", 1)], "document_id string, source string, target string, relation string, rel_seq int")
    got = {(r["document_id"], r["source_id"], r["target_id"]): r["relation"] for r in graph.cooccurrences(mentions, relations).collect()}
    assert got["d", "a", "b"] == got["d", "b", "a"] == "sattı" and got["d", "b", "c"] == got["d", "c", "b"] == "gördü" and got["d", "a", "c"] == ""
    assert got["e", "a", "b"] == got["e", "b", "a"] == "sattı"  # b is mentioned again after a
    with pytest.raises(KeyError):
        graph.node(mentions.select("node_id", "label"), "yok")


def test_bm25_keeps_clear_of_user_columns(spark):
    rows = spark.createDataFrame([(1, "bir iki üç", 9.0, 5, 1), (2, "iki iki", 8.0, 4, 2), (3, None, 7.0, 3, 3)], "id int, text string, score double, df int, rank int")
    got = ranking.bm25_top(rows, "iki üç", 2, order="id").collect()
    assert [r["id"] for r in got] == [1, 2] and set(got[0].asDict()) == {"id", "text", "score", "df", "rank"}
    plan = ranking.bm25(rows, "iki")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_vault_keeps_numbers_across_batches(spark):
    one = pii_tr.detect(spark.createDataFrame([("a", 0, "TC kimlik no: 10000000146")], "document_id string, ingest_seq long, raw_text string"))
    first = pii_tr.vault(one)
    two = pii_tr.detect(spark.createDataFrame([("b", 1, "10000000146 ve T.C. Kimlik No: 12345678901")], "document_id string, ingest_seq long, raw_text string"))
    assert pii_tr.redact(two, pii_tr.vault(two, first)).first()["text"] == "[TCKN_1] ve T.C. Kimlik No: [TCKN_2]"


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_text("merhaba", encoding="utf-8")
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "p.pdf").write_bytes(b"x")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>bir</w:t></w:r></w:p><w:p><w:r><w:t>iki</w:t></w:r></w:p></w:body></w:document>')
    got = {r["title"]: (r["raw_text"], r["error"] is None) for r in loaders.load(spark, str(tmp_path), lambda data: ["birinci\n", "ikinci"]).collect()}
    assert got == {"a": ("merhaba", True), "b": (None, False), "c": ("bir\niki", True), "p": ("birinci\nikinci", True)}


def test_masking_keeps_private_signs_and_repeated_rows(spark):
    odd = "önce \ue000iç\ue001 \ue002\ue003 ali@example.com \ue002"
    rows = [("a", 0, odd), ("a", 0, odd), ("a", 0, "veli@example.com"), ("b", 1, None), ("c", 2, "\ue000")]
    found = pii_tr.detect(spark.createDataFrame(rows, "document_id string, ingest_seq long, raw_text string"))
    got = sorted(tuple(r) for r in pii_tr.redact(found, pii_tr.vault(found)).collect())
    assert got == sorted([("a", odd.replace("ali@example.com", "[EMAIL_1]"))] * 2 + [("a", "[EMAIL_2]"), ("b", ""), ("c", "\ue000")])


COLUMNS = "document_id string, ingest_seq long, uri string, raw_text string, created_at string"
ROWS = [
    ("a", 0, "x/a.txt", "Acme Holding, Proje Zeus için Beta Firması ile anlaştı. TC kimlik no: 10000000146", "2024-01-01"),
    ("b", 1, "x/b.txt", "Proje Zeus kapsamında Gamma Danışmanlık teknik destek verdi.", "2024-01-02"),
]


def opened(spark, path, **more):
    return Archive(spark, str(path), embed=lambda t: F.array(F.length(t).cast("double"), F.lit(1.0)), complete=more.pop("complete", lambda p: "yanıt"), **more)


def test_archive_end_to_end(spark, tmp_path):
    archive = opened(spark, tmp_path)
    assert archive.answer("soru", [1.0, 1.0])["sources"] == []
    archive.ingest(spark.createDataFrame(ROWS, COLUMNS))
    assert archive.stats().first()["documents"] == 2 and archive.stats().first()["pii_masked"] == 1
    assert all("10000000146" not in r["text"] for r in archive.table("chunks").collect())
    found = archive.connection("ACME HOLDİNG A.Ş.", "Gamma Danışmanlık")
    assert found["found"] and "Proje Zeus" in found["nodes"] and found["confidence"] == 0.25
    assert [s["name"] for s in archive.answer("Gamma", [1.0, 1.0])["sources"]] and archive.documents().first()["document_id"] == "b"
    event = archive.audit_events().first()
    assert event["action"] == "REDACT" and event["timestamp"] and event["placeholder"] == "[TCKN_1]"
    assert archive.delete("b") and not archive.delete("b")
    assert not archive.connection("Acme Holding", "Gamma Danışmanlık")["found"] and archive.connection("Acme Holding", "Proje Zeus")["found"]
    assert archive.clear() == 1 and archive.stats().first()["nodes"] == 0 and archive.stats().first()["pii_masked"] == 1


def test_archive_is_durable_idempotent_and_atomic(spark, tmp_path):
    archive = opened(spark, tmp_path)
    archive.ingest(spark.createDataFrame(ROWS, COLUMNS))
    again = opened(spark, tmp_path)
    assert again.parts == archive.parts and again.table("catalog").count() == 2 and again.table("vault").count() == 1
    # a document that is there already doubles nothing, and numbers keep their meaning
    more = [ROWS[0], ("c", 2, "x/c.txt", "Kimlik no: 10000000146 ve ali@example.com", "2024-01-03")]
    again.ingest(spark.createDataFrame(more, COLUMNS))
    chunks = again.table("chunks").collect()
    assert sorted(r["chunk_id"] for r in chunks) == ["a#0", "b#0", "c#0"] and again.table("catalog").count() == 3
    assert [r["text"] for r in chunks if r["document_id"] == "c"] == ["Kimlik no: [TCKN_1] ve [EMAIL_1]"] and again.table("audit").count() == 2
    merged = again.table("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("size").alias("size")).filter("df <> 0")
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, ranking.statistics(again.table("chunks")).collect()))
    with pytest.raises(Conflict):  # the first object doesn't know of this
        archive._commit(add={"memo": spark.createDataFrame([("k", "v")], SCHEMAS["memo"])})
    archive.refresh()
    assert archive.parts == again.parts
    # a failing write leaves everything as it was
    bad = again.table("audit").withColumn("action", F.raise_error(F.lit("disk full")).cast("string"))
    with pytest.raises(Exception, match="disk full"):
        again._commit(add={"memo": spark.createDataFrame([("k", "v")], SCHEMAS["memo"]), "audit": bad})
    assert archive.parts == again.parts == opened(spark, tmp_path).parts and again.table("memo").count() == 0
    assert again.health()["storage"] and again.health(probe=lambda: 1 / 0)["llm"] is False
    again.reset()
    assert opened(spark, tmp_path).table("vault").count() == opened(spark, tmp_path).table("catalog").count() == 0


def test_archive_reads_files_and_keeps_states(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Acme Holding ile Proje Zeus.", encoding="utf-8")
    (tmp_path / "in" / "b.png").write_bytes(b"x")
    archive = opened(spark, tmp_path / "own")
    with pytest.raises(IngestionError):  # and yet both are recorded
        archive.ingest_files(str(tmp_path / "in"), strict=True)
    got = {r["name"]: (r["document_id"], r["state"]) for r in archive.table("catalog").collect()}
    assert {n: s for n, (_, s) in got.items()} == {"a.txt": "PARSED", "b.png": "FAILED"}
    good, bad = got["a.txt"][0], got["b.png"][0]
    assert [h["state"] for h in archive.document(good)["history"]] == ["RECEIVED", "PARSING"] and "unsupported" in archive.document(bad)["history"][1]["note"]
    assert archive.node("ACME HOLDİNG A.Ş.") == "Acme Holding"
    archive.advance(good, "ARCHIVED", "bitti")
    with pytest.raises(InvalidTransition):
        archive.advance(good, "PARSING")
    with pytest.raises(KeyError):
        archive.document("yok")
    with pytest.raises(KeyError):
        archive.node("Yok Şirketi")
    assert opened(spark, tmp_path / "own").document(good)["history"][-1] == {"state": "PARSED", "note": "bitti"}


def test_model_names_relations_and_memo(spark, tmp_path):
    log = tmp_path / "asked"
    log.mkdir()

    def model(prompt):
        (log / uuid.uuid4().hex).write_text(prompt, encoding="utf-8")
        if "İLİŞKİLER" in prompt:
            return "ACME HOLDİNG A.Ş. | anlaştı | Beta Firması\x0bUydurma | sattı | Beta Firması"
        return "1. Acme Holding\n- Beta Firması\n- Proje Zeus\n* Olmayan Kurum" if "VARLIKLAR:" in prompt else "yanıt"

    archive = opened(spark, tmp_path / "own", complete=model, by_model=True)
    text = "Acme Holding ile Beta Firması, Proje Zeus için anlaştı."
    rows = [("a", 0, "x/a.txt", text, "2024-01-01"), ("b", 1, "x/b.txt", text, "2024-01-02")]
    archive.ingest(spark.createDataFrame(rows, COLUMNS))
    assert len(list(log.iterdir())) == 2  # one prompt of each kind: the second document has the same text
    edges = {(r["source_id"], r["target_id"]): (r["relation"], r["confidence"]) for r in archive.edges().collect()}
    assert edges["acme", "beta firmasi"] == edges["beta firmasi", "acme"] == ("anlaştı", 0.8) if ("acme", "beta firmasi") in edges else ("anlaştı", 0.8) in edges.values()
    assert {v for v in edges.values()} == {("anlaştı", 0.8), ("", 0.5)} and archive.nodes().count() == 3
    archive.answer("soru?", [1.0, 1.0]), archive.answer("soru?", [1.0, 1.0])
    assert len(list(log.iterdir())) == 3 and opened(spark, tmp_path / "own").table("memo").count() == 3


def test_stream_of_files(spark, tmp_path):
    for folder in ("landing", "own"):
        (tmp_path / folder).mkdir()
    (tmp_path / "landing" / "a.txt").write_text("Acme Holding. ali@example.com", encoding="utf-8")
    (tmp_path / "landing" / "b.txt").write_text("Proje Zeus. ali@example.com", encoding="utf-8")
    archive = opened(spark, tmp_path / "own")
    ingest.follow(spark, archive, str(tmp_path / "landing"), str(tmp_path / "mark")).awaitTermination()
    assert archive.table("catalog").count() == 2 and archive.table("vault").count() == 1
    assert archive.table("catalog").select("ingest_seq").distinct().count() == 2
