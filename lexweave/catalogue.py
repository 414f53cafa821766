"""The engine's queries, named after its operators, and the SQL that each must equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions import text_tr as t
from lexweave.functions import validators
from lexweave.operators import chunking, entities, graph, pii_tr, ranking, relational
from lexweave.sources import loaders
from lexweave.sources.shared import saved as _saved

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _values(spark: SparkSession, values: list, schema: str = "x string") -> DataFrame:
    return spark.createDataFrame([v if isinstance(v, tuple) else (v,) for v in values], schema)


def _sql(values: list) -> str:
    """VALUES rows of literals."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(map(lit, v if isinstance(v, tuple) else (v,))) + ")" for v in values)


# --- chunks ----------------------------------------------------------------------------------

_BM25_SQL = """
    WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(replace(replace(coalesce(text, ''), 'I', 'ı'), 'İ', 'i')), '\\s+'), lambda w: w <> '') AS terms FROM {rows}),
    p AS (SELECT doc_id, term, count(*) AS tf, any_value(len) AS len FROM (SELECT doc_id, len(terms) AS len, unnest(terms) AS term FROM d) GROUP BY ALL),
    s AS (SELECT count(*)::DOUBLE AS n, avg(len(terms))::DOUBLE AS mean_len FROM d),
    raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS idf FROM (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY term), s),
    i AS (SELECT term, CASE WHEN idf < 0 THEN 0.25 * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
    q AS (SELECT unnest(['the', 'thand', 'erea', 'the']) AS term),
    r AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / mean_len))) AS score FROM q JOIN p USING (term) JOIN i USING (term), s GROUP BY doc_id)
    SELECT d.doc_id, round(coalesce(score, 0.0), 6) AS score FROM d LEFT JOIN r USING (doc_id) ORDER BY coalesce(score, 0.0) DESC, doc_id LIMIT 10
"""


def _bm25(docs: DataFrame) -> DataFrame:
    return ranking.bm25_top(docs, "the thand erea the", 10, order="doc_id").select("doc_id", F.round("score", 6).alias("score"))


@query()
def chunk_documents(spark, d):
    return chunking.chunk(_read(spark, d, "documents"), key="doc_id")


@query("""
    WITH RECURSIVE w AS (SELECT conv_id * 1000 + turn AS id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS words FROM conversations),
    f AS (SELECT id, words, list_transform(words, lambda x: len(x) + 1) AS cost, 1 AS k, 0 AS begin_, 0 AS used, NULL::VARCHAR AS done FROM w WHERE len(words) > 0
          UNION ALL
          SELECT id, words, cost, k + 1,
                 CASE WHEN cut THEN tail ELSE begin_ END, CASE WHEN cut THEN coalesce(list_sum(cost[tail + 1 : k - 1]), 0) ELSE used END + cost[k],
                 CASE WHEN cut THEN array_to_string(words[begin_ + 1 : k - 1], ' ') END
          FROM (SELECT *, k - 1 > begin_ AND used + cost[k] > 120 AS cut,
                       k - 1 - coalesce(list_max(list_filter(range(0, k), lambda n: coalesce(list_sum(cost[k - n : k - 1]), 0) <= 20)), 0) AS tail FROM f WHERE k <= len(words)) z),
    c AS (SELECT id, k, done FROM f WHERE done IS NOT NULL
          UNION ALL SELECT id, k + 1, array_to_string(words[begin_ + 1 :], ' ') FROM f WHERE k = len(words) + 1)
    SELECT id, (row_number() OVER (PARTITION BY id ORDER BY k) - 1)::INTEGER AS ord, done AS text FROM c
""")
def chunk_turns(spark, d):
    rows = _read(spark, d, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn"))
    return chunking.chunk(rows, 120, 20, key="id")


@query(_BM25_SQL.format(rows="documents"))
def bm25_topk(spark, d):
    return _bm25(_read(spark, d, "documents"))


@query(_BM25_SQL.format(rows="documents WHERE source <> 'src0'"))
def bm25_delete(spark, d):
    return _bm25(_read(spark, d, "documents").filter("source <> 'src0'"))


@query()
def bm25_chunks(spark, d):
    """The flagship: chunks of all documents, ranked by BM25."""
    chunks = chunking.chunk(_read(spark, d, "documents"), key="doc_id").withColumn("chunk_id", F.concat_ws("#", "doc_id", "ord"))
    top = ranking.bm25(chunks, "the thand erea").orderBy(F.desc("score"), "doc_id", "ord").limit(10)
    return top.select("chunk_id", F.round("score", 6).alias("score"), "text")


# --- vectors and fusion ----------------------------------------------------------------------


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round((embedding[1] / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))))::DOUBLE, 5) AS first FROM embeddings")
def vector_normalize(spark, d):
    e = _read(spark, d, "embeddings")
    return e.select("vec_id", F.round(ranking.norm(F.col("embedding")), 5).alias("norm"), F.round(F.element_at(ranking.normalised(F.col("embedding")), 1), 5).alias("first"))


def _query_vector(spark, d) -> list[float]:
    return list(_read(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"])


_VECTOR_SQL = "SELECT vec_id, list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)) AS s FROM embeddings ORDER BY s DESC, vec_id LIMIT 10"


@query(f"SELECT vec_id, round(s, 6) AS score FROM ({_VECTOR_SQL})")
def vector_topk(spark, d):
    return ranking.cosine_top(_read(spark, d, "embeddings"), _query_vector(spark, d), 10, order="vec_id").select("vec_id", F.round("score", 6).alias("score"))


def _hybrid(spark, d) -> DataFrame:
    by_vector = ranking.ranked(ranking.cosine_top(_read(spark, d, "embeddings"), _query_vector(spark, d), 10, order="vec_id"), "vec_id", "vec_id")
    by_word = ranking.ranked(ranking.bm25_top(_read(spark, d, "documents"), "the thand erea the", 10, order="doc_id"), "doc_id", "doc_id")
    return ranking.fuse([by_vector, by_word])


_HYBRID_SQL = f"""
    v AS (SELECT vec_id AS id, row_number() OVER (ORDER BY s DESC, vec_id) AS rank, 0 AS l FROM ({_VECTOR_SQL})),
    b AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, 1 AS l FROM ({_BM25_SQL.format(rows="documents")})),
    f AS (SELECT id, sum(1.0::DOUBLE / (60 + rank)) AS rrf, min(l * 1000 + rank) AS first FROM (FROM v UNION ALL FROM b) GROUP BY id)
"""


@query(f"WITH {_HYBRID_SQL} SELECT id, round(rrf, 8) AS rrf FROM f")
def hybrid_rrf(spark, d):
    return _hybrid(spark, d).select("id", F.round("rrf", 8).alias("rrf"))


@query(f"WITH {_HYBRID_SQL}, t AS (SELECT text, rrf, first FROM f JOIN documents ON id = doc_id QUALIFY row_number() OVER (ORDER BY rrf DESC, first) <= 3) SELECT string_agg(text, chr(10) || chr(10) ORDER BY rrf DESC, first) AS context FROM t")
def context_sources(spark, d):
    return ranking.context(_hybrid(spark, d), _read(spark, d, "documents"), "doc_id")


# --- Turkish texts ---------------------------------------------------------------------------

_NAMES = ["Gamma Danışmanlık LTD. ŞTİ.", "Delta Yazılım A.Ş.", "Acme Holding", "ACME HOLDİNG A.Ş.", "ACME HOLDING", "Gamma Danismanlik", "GAMMA DANIŞMANLIK LTD. ŞTİ.", "TÜBİTAK", "IRMAK", "İZMİR", "İzmir Limanı", "X INC.", "A.Ş.", "Proje  Zeus", "ısparta ili", "kâğıt Çağrı"]
_LOWER = "lower(replace(replace({x}, 'I', 'ı'), 'İ', 'i'))"
_SUFFIXES = "[" + ", ".join(f"'{s}'" for s in t.COMPANY_SUFFIXES) + "]"
_STRIP = f"""
    WITH n AS (SELECT x, list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '') AS w FROM (VALUES {_sql(_NAMES)}) AS v(x)),
    k AS (SELECT x, w, coalesce(list_max(list_transform(range(1, len(w) + 1), lambda i: CASE WHEN list_contains({_SUFFIXES}, trim({_LOWER.format(x="w[i]")}, ',;:')) THEN 0 ELSE i END)), 0) AS keep FROM n),
    s AS (SELECT x, CASE WHEN keep > 0 THEN array_to_string(w[1:keep], ' ') ELSE trim(x) END AS stripped FROM k)
"""


@query(f"SELECT x, {_LOWER.format(x='x')} AS low, array_to_string(list_filter(regexp_split_to_array({_LOWER.format(x='x')}, '\\s+'), lambda w: w <> ''), ' ') AS key, translate({_LOWER.format(x='x')}, '{t.FOLD_FROM}', '{t.FOLD_TO}') AS folded FROM (VALUES {_sql(_NAMES)}) AS v(x)")
def tr_normalize(spark, d):
    x = F.col("x")
    return _values(spark, _NAMES).select("x", t.lower_tr(x).alias("low"), t.canonical_key(x).alias("key"), t.fold(x).alias("folded"))


@query(f"{_STRIP} SELECT x, stripped, translate({_LOWER.format(x='stripped')}, '{t.FOLD_FROM}', '{t.FOLD_TO}') AS key FROM s")
def entity_key(spark, d):
    x = F.col("x")
    return _values(spark, _NAMES).select("x", t.strip_company_suffix(x).alias("stripped"), t.entity_key(x).alias("key"))


_TITLE = f"array_to_string(list_transform(regexp_split_to_array({_LOWER.format(x='{x}')}, ' '), lambda w: upper(translate(left(w, 1), 'iı', 'İI')) || substr(w, 2)), ' ')"


@query(f"{_STRIP} SELECT x, CASE WHEN stripped = upper(stripped) AND stripped <> lower(stripped) AND contains(stripped, ' ') THEN {_TITLE.format(x='stripped')} ELSE stripped END AS label FROM s")
def display_label(spark, d):
    return _values(spark, _NAMES).select("x", t.display_label(F.col("x")).alias("label"))


_VERSIONS = [("a", 1, "ACME HOLDİNG"), ("a", 2, "Acme Holding"), ("b", 1, "Acme Holding"), ("b", 2, "ACME HOLDİNG"), ("c", 1, "Zeus Projesi"), ("c", 2, "Zeus"), ("c", 3, "Zeüs")]


@query(f"SELECT k, label FROM (VALUES {_sql(_VERSIONS)}) AS v(k, seq, label) QUALIFY row_number() OVER (PARTITION BY k ORDER BY label = upper(label) AND label <> lower(label), length(label), seq) = 1")
def prefer_label(spark, d):
    return _values(spark, _VERSIONS, "k string, seq int, label string").groupBy("k").agg(F.min_by("label", t.preference(F.col("label"), F.col("seq"))).alias("label"))


_NUMBERS = ["10000000146", "10000000145", "123", "01234567890", "1234567890", "1234567891", "4560123789", "0290384756", "34567890123", "12345678901", "TR330006100519786457841326", "TR330006100519786457841327", "TR12 0001 0002 0003 0004 0005 06", "tr33 0006 1005 1978 6457 8413 26", "x", ""]


@query(f"""
    WITH v AS (SELECT x, regexp_full_match(x, '[1-9][0-9]{{10}}') AS t, regexp_full_match(x, '[0-9]{{10}}') AS k, upper(replace(x, ' ', '')) AS i FROM (VALUES {_sql(_NUMBERS)}) AS v(x)),
    d AS (SELECT *, list_transform(range(1, 12), lambda p: coalesce(TRY_CAST(substr(x, p, 1) AS INTEGER), 0)) AS d FROM v)
    SELECT x,
        t AND ((((d[1] + d[3] + d[5] + d[7] + d[9]) * 7 - (d[2] + d[4] + d[6] + d[8])) % 10) + 10) % 10 = d[10] AND list_sum(d[1:10]) % 10 = d[11] AS tckn,
        k AND (10 - list_sum(list_transform(range(0, 9), lambda p: CASE WHEN (d[p + 1] + 9 - p) % 10 = 0 THEN 0 WHEN (((d[p + 1] + 9 - p) % 10) * (2 ** (9 - p))::INTEGER) % 9 = 0 THEN 9 ELSE (((d[p + 1] + 9 - p) % 10) * (2 ** (9 - p))::INTEGER) % 9 END)) % 10) % 10 = d[10] AS vkn,
        regexp_full_match(i, 'TR[0-9]{{24}}') AND coalesce(TRY_CAST(substr(i, 5) || '2927' || substr(i, 3, 2) AS HUGEINT), 0) % 97 = 1 AS iban
    FROM d
""")
def validators_tr(spark, d):
    x = F.col("x")
    return _values(spark, _NUMBERS).select("x", validators.valid_tckn(x).alias("tckn"), validators.valid_vkn(x).alias("vkn"), validators.valid_iban_tr(x).alias("iban"))


# --- personal data ---------------------------------------------------------------------------

_LETTERS = [
    ("d1", 0, "TC kimlik no: 10000000146 ve ali@example.com, TR33 0006 1005 1978 6457 8413 26"), ("d2", 1, "Sözleşme no: 12345678901. Telefon: 05321234567"), ("d3", 2, "Zeynep Demir (T.C. Kimlik No: 12345678901), ali@example.com"),
    ("d4", 3, "Vergi Kimlik Numarası 4560123789 olup 10000000146 ile 10000000146"), ("d5", 4, "Hesap: TR12 0001 0002 0003 0004 0005 06"), ("d6", 5, None), ("d7", 6, "Belge referansı 12345678901 şeklindedir."),
]
_MASKED = [
    ("d1", "TC kimlik no: [TCKN_1] ve [EMAIL_1], [IBAN_1]"), ("d2", "Sözleşme no: 12345678901. Telefon: [PHONE_1]"), ("d3", "Zeynep Demir (T.C. Kimlik No: [TCKN_2]), [EMAIL_1]"), ("d4", "Vergi Kimlik Numarası [VKN_1] olup [TCKN_1] ile [TCKN_1]"),
    ("d5", "Hesap: [IBAN_2]"), ("d6", ""), ("d7", "Belge referansı 12345678901 şeklindedir."),
]


def _letters(spark) -> DataFrame:
    return pii_tr.detect(_values(spark, _LETTERS, "document_id string, ingest_seq long, raw_text string"))


@query(f"SELECT * FROM (VALUES {_sql(_MASKED)}) AS v(document_id, text)")
def pii_redact(spark, d):
    found = _letters(spark)
    return pii_tr.redact(found, pii_tr.vault(found))


@query("SELECT doc_id, len(m) AS n_email FROM (SELECT doc_id, regexp_extract_all(text, '[\\p{L}\\p{N}_.\\-]+@[\\p{L}\\p{N}_.\\-]+\\.[\\p{L}\\p{N}_]+') AS m FROM documents) WHERE len(m) > 0")
def pii_detect(spark, d):
    found = pii_tr.detect(_read(spark, d, "documents"), "text")
    return pii_tr.exploded(found, "doc_id").filter("h.pii_type = 'EMAIL'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_email"))


@query("SELECT * FROM (VALUES ('IBAN', '[IBAN_1]', 0), ('TCKN', '[TCKN_1]', 0), ('EMAIL', '[EMAIL_1]', 0), ('PHONE', '[PHONE_1]', 1), ('TCKN', '[TCKN_2]', 2), ('VKN', '[VKN_1]', 3), ('IBAN', '[IBAN_2]', 4)) AS v(pii_type, placeholder, first_seq)")
def pii_vault(spark, d):
    return pii_tr.vault(_letters(spark)).select("pii_type", "placeholder", "first_seq")


@query("SELECT * FROM (VALUES (1, 'REDACT', 'IBAN', '[IBAN_1]', 't'), (2, 'REDACT', 'TCKN', '[TCKN_1]', 't'), (3, 'REDACT', 'EMAIL', '[EMAIL_1]', 't'), (4, 'REDACT', 'PHONE', '[PHONE_1]', 't'), (5, 'REDACT', 'TCKN', '[TCKN_2]', 't'), (6, 'REDACT', 'VKN', '[VKN_1]', 't'), (7, 'REDACT', 'IBAN', '[IBAN_2]', 't')) AS v(seq, action, pii_type, placeholder, timestamp)")
def audit_log(spark, d):
    return pii_tr.audit(pii_tr.vault(_letters(spark)), F.lit("t"))


# The same over all documents and types. SQL can't follow the six passes; the tests compare with brute force.


def _marked(spark, d) -> DataFrame:
    """All documents, detected. A repeated doc_id with another text is a document of its own."""
    own = F.struct("doc_id", F.sha2("text", 256).alias("sha256"))
    return pii_tr.detect(_read(spark, d, "documents").select(own.alias("document_id"), F.col("doc_id").alias("ingest_seq"), F.col("text").alias("raw_text")))


@query()
def pii_redact_documents(spark, d):
    found = _saved(_marked(spark, d).drop("raw_text"))
    return pii_tr.redact(found, _saved(pii_tr.vault(found))).select("document_id.doc_id", "text")


@query()
def pii_detect_types(spark, d):
    found = pii_tr.detect(_read(spark, d, "documents"), "text")
    return pii_tr.exploded(found, "doc_id").groupBy("doc_id", "h.pii_type").agg(F.count(F.lit(1)).alias("n"))


@query()
def pii_vault_documents(spark, d):
    return pii_tr.vault(_marked(spark, d)).select("pii_type", "placeholder", F.sha2("value", 256).alias("value_sha256"), "first_seq")


@query()
def audit_log_documents(spark, d):
    return pii_tr.audit(_saved(pii_tr.vault(_marked(spark, d)))).select("seq", "pii_type", "placeholder")


# --- entities and relations ------------------------------------------------------------------


@query()
def entity_regex(spark, d):
    return _read(spark, d, "documents").select("doc_id", F.posexplode(entities.regex_names(F.col("text"))).alias("pos", "name"))


_CANDIDATES = ["Acme Holding", "Proje Zeus", "Gamma Danışmanlık LTD. ŞTİ.", "Ayşe Yıldız", "TR33 0006 1005 1978 6457 8413 26", "10000000146", "[TCKN_1]", "VKN_2", "DLT-2024-0053", "Maslak Mahallesi Büyükdere Caddesi No: 128", "Sayın İlgili", "Saygılarımızla", "Teknik Gereksinim Analizi", "14 Mart 2024", "128", "Genel Müdürlük Binası Yedinci Kat Büyük Toplantı Salonu Girişi", "Tüm Birimler", "Konu: İş Birliği", "VERGİ KİMLİK NUMARASI 4560123789", "Proje Ekibi", "TÜRKİYE", '"Müşteri"', "MUSTERI", "Şirket", "", "  ", "é"]
_KEPT = {"Acme Holding", "Proje Zeus", "Gamma Danışmanlık LTD. ŞTİ.", "Ayşe Yıldız"}


@query(f"SELECT * FROM (VALUES {_sql([(c, int(c in _KEPT)) for c in _CANDIDATES])}) AS v(x, kept)")
def entity_filter(spark, d):
    return _values(spark, _CANDIDATES).select("x", (~entities.rejected(F.col("x"))).cast("int").alias("kept"))


@query()
def entity_filter_turns(spark, d):
    """Every distinct word and run of capitalised words of all conversations; SQL can't follow the runs."""
    turns = _read(spark, d, "conversations").select(F.explode(F.array_distinct(F.concat(t.words(F.col("text")), entities.regex_names(F.col("text"))))).alias("x"))
    return turns.groupBy("x").agg(F.count(F.lit(1)).alias("turns")).withColumn("kept", (~entities.rejected(F.col("x"))).cast("int"))


_REPLIES = [(1, "Acme Holding\nProje Zeus\nBeta Firması"), (2, "- Acme Holding\n2. Proje Zeus\n* Beta Firması"), (3, "Acme Holding\n\nAcme Holding\n   \nProje Zeus"), (4, None)]


@query(f"SELECT * FROM (VALUES {_sql([(1, 'Acme Holding|Proje Zeus|Beta Firması'), (2, 'Acme Holding|Proje Zeus|Beta Firması'), (3, 'Acme Holding|Proje Zeus'), (4, '')])}) AS v(id, names)")
def entity_parse(spark, d):
    return _values(spark, _REPLIES, "id int, x string").select("id", F.array_join(entities.parse_entities(F.col("x")), "|").alias("names"))


_TRIPLES = "ACME HOLDİNG A.Ş. | anlaştı | Beta Firması\nAcme Holding | yok\nAcme Holding | bir iki üç dört beş | Beta Firması\nUydurma | sattı | Beta Firması\nAcme Holding | kendi | ACME HOLDING"


@query("SELECT 'Acme Holding' AS source, 'anlaştı' AS relation, 'Beta Firması' AS target")
def relation_parse(spark, d):
    row = _values(spark, [(_TRIPLES, ["Acme Holding", "Beta Firması"])], "x string, e array<string>")
    return row.select(F.explode(entities.parse_relations(F.col("x"), F.col("e"), t.entity_key)).alias("r")).select("r.*")


_TEXT = "Taraflar ACME HOLDİNG A.Ş. ile GAMMA DANIŞMANLIK arasında anlaştı."
_GROUND = [("ACME HOLDING", "ACME HOLDİNG"), ("Gamma Danışmanlık", "GAMMA DANIŞMANLIK"), ("Delta Lojistik", None), ("ACME HOLDİNİNG A.Ş.", "ACME HOLDİNG A.Ş."), ("", None)]


@query(f"SELECT * FROM (VALUES {_sql(_GROUND)}) AS v(x, spelling)")
def locate_in_source(spark, d):
    return entities.ground(_values(spark, [(g, _TEXT) for g, _ in _GROUND], "x string, source string"), "x", "source").select("x", "spelling")


# --- graph -----------------------------------------------------------------------------------


def _mentions(spark, d) -> DataFrame:
    """Orders as documents, suppliers as entities."""
    own = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_suppkey").alias("node_id"), F.col("l_linenumber").alias("n"))
    return own.withColumn("label", F.concat(F.lit("Supplier "), F.col("node_id"))).withColumn("seq", F.col("document_id") * 100 + F.col("n"))


_PAIRS_SQL = """
    m AS (SELECT l_orderkey AS document_id, l_suppkey AS node_id, min(l_orderkey * 100 + l_linenumber) AS seq FROM lineitem GROUP BY ALL),
    pairs AS (SELECT a.document_id, a.seq, a.node_id AS source_id, b.node_id AS target_id FROM m a JOIN m b ON a.document_id = b.document_id AND a.node_id <> b.node_id),
    es AS (SELECT DISTINCT source_id, target_id, document_id FROM pairs)
"""


@query(f"WITH {_PAIRS_SQL} SELECT source_id, target_id, count(*) AS documents, 0.5::DOUBLE AS confidence FROM pairs GROUP BY ALL")
def cooccurrence_edges(spark, d):
    return graph.cooccurrences(_mentions(spark, d)).groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("documents"), F.first("confidence").alias("confidence"))


@query(f"""
    WITH {_PAIRS_SQL}, r AS (SELECT *, CASE WHEN document_id % 7 = 0 THEN 'supplied' ELSE '' END AS relation FROM pairs)
    SELECT source_id, target_id, relation, CASE WHEN relation = '' THEN 0.5::DOUBLE ELSE 0.8::DOUBLE END AS confidence FROM r
    QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY seq DESC, document_id DESC) = 1
""")
def edge_last_write(spark, d):
    mentions = _mentions(spark, d)
    pairs = graph.cooccurrences(mentions).filter("document_id % 7 = 0 and source_id < target_id")
    relations = pairs.select("document_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit("supplied").alias("relation"), F.col("seq").alias("rel_seq"))
    return graph.last_write(graph.cooccurrences(mentions, relations)).select("source_id", "target_id", "relation", "confidence")


@query("SELECT l_suppkey AS node_id, count(DISTINCT l_orderkey) AS documents, 'Supplier ' || l_suppkey AS label FROM lineitem GROUP BY l_suppkey")
def provenance(spark, d):
    m = _mentions(spark, d)
    return graph.provenance(m).groupBy("node_id").agg(F.count(F.lit(1)).alias("documents")).join(graph.nodes(m), "node_id")


@query("""
    WITH m AS (SELECT DISTINCT l_orderkey AS document_id, l_partkey AS node_id FROM lineitem),
    es AS (SELECT a.document_id, a.node_id AS source_id, b.node_id AS target_id FROM m a JOIN m b ON a.document_id = b.document_id AND a.node_id <> b.node_id),
    doc AS (SELECT min(document_id) AS document_id FROM m),
    dead AS (SELECT node_id FROM m WHERE document_id = (FROM doc) EXCEPT SELECT node_id FROM m WHERE document_id <> (FROM doc)),
    gone AS (SELECT source_id, target_id FROM es WHERE document_id = (FROM doc) EXCEPT SELECT source_id, target_id FROM es WHERE document_id <> (FROM doc)),
    e AS (SELECT DISTINCT source_id, target_id FROM es)
    SELECT (SELECT count(DISTINCT node_id) FROM m WHERE node_id NOT IN (FROM dead)) AS nodes,
           (SELECT count(*) FROM e ANTI JOIN gone USING (source_id, target_id) WHERE source_id NOT IN (FROM dead) AND target_id NOT IN (FROM dead)) AS edges,
           (SELECT count(*) FROM m WHERE document_id <> (FROM doc)) AS node_sources
""")
def provenance_delete(spark, d):
    m = _mentions(spark, d).drop("node_id").join(_read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("node_id")), ["document_id", "n"])
    edges = graph.cooccurrences(m)
    first = m.agg(F.min("document_id")).first()[0]
    n, e, ns, _ = graph.delete_document(F.lit(first), graph.nodes(m), graph.last_write(edges), graph.provenance(m), edges.select("source_id", "target_id", "document_id").distinct())
    return relational.stats(nodes=n, edges=e, node_sources=ns)


_EDGES = [("A", "X", 0.9, "r1"), ("X", "B", 0.9, "r2"), ("A", "Y", 0.5, "r3"), ("Y", "B", 0.5, "r4"), ("B", "C", 0.8, ""), ("Z", "Z2", 0.9, "")]


@query("SELECT true AS found, 'A|X|B|C' AS nodes, 'r1|r2|' AS relations, 0.648::DOUBLE AS confidence")
def connection_path(spark, d):
    edges = _values(spark, _EDGES, "source_id string, target_id string, confidence double, relation string").withColumn("weight", -F.log("confidence"))
    nodes = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).distinct().withColumn("label", F.col("node_id"))
    found = graph.described_path(graph.most_reliable_path(edges, "A", "C", save=lambda x: x), nodes)
    return found.select("found", F.array_join("nodes", "|").alias("nodes"), F.array_join("relations", "|").alias("relations"), "confidence")


def _parts(spark, d) -> DataFrame:
    """Orders as documents, parts as entities; ids as text, as in the archive."""
    own = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_partkey").cast("string").alias("node_id"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("seq"))
    return own.withColumn("label", F.concat(F.lit("Part "), F.col("node_id")))


@query()
def connection_path_parts(spark, d):
    """From the smallest to the largest part, through the orders; every seventh order's pairs are typed."""
    m = _parts(spark, d)
    pairs = graph.cooccurrences(m).filter("document_id % 7 = 0 and source_id < target_id")
    relations = pairs.select("document_id", F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit("supplied").alias("relation"), F.col("seq").alias("rel_seq"))
    edges = _saved(graph.last_write(graph.cooccurrences(m, relations)))
    ends = _read(spark, d, "lineitem").agg(F.min("l_partkey"), F.max("l_partkey")).first()
    found = graph.described_path(graph.most_reliable_path(edges, *map(str, ends), save=_saved), graph.nodes(m))
    return found.select("found", F.array_join("nodes", "|").alias("nodes"), F.array_join("relations", "|").alias("relations"), "confidence")


@query("SELECT l_suppkey AS node_id FROM lineitem WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1) AND l_suppkey <> 1 GROUP BY 1")
def graph_neighbours(spark, d):
    edges = graph.last_write(graph.cooccurrences(_mentions(spark, d)))
    return graph.neighbours(edges, 1).select(F.col("target_id").alias("node_id"))


# --- catalog, views, state, cache ------------------------------------------------------------


def _catalog(spark, d) -> DataFrame:
    docs = _read(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("ingest_seq"), relational.base_name(F.concat_ws("/", F.lit("in"), "source", F.concat("doc_id", F.lit(".txt")))).alias("name"), F.lit("PARSED").alias("state"), F.concat(F.lit("2024-01-"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0")).alias("created_at"))


_CATALOG_SQL = "SELECT doc_id::VARCHAR AS document_id, doc_id AS ingest_seq, doc_id || '.txt' AS name, 'PARSED' AS state, '2024-01-' || lpad((doc_id % 28 + 1)::VARCHAR, 2, '0') AS created_at FROM documents"


@query("SELECT k, min(o_orderkey) AS seq, arg_max(o_totalprice, o_orderkey) AS price FROM (SELECT *, o_custkey % 500 AS k FROM orders) GROUP BY k")
def catalog_upsert(spark, d):
    rows = _read(spark, d, "orders").select((F.col("o_custkey") % 500).alias("k"), F.col("o_orderkey").alias("seq"), F.col("o_totalprice").alias("price"))
    return relational.upsert(rows, "k", "seq")


@query(f"SELECT document_id, name, created_at FROM ({_CATALOG_SQL}) ORDER BY created_at DESC, ingest_seq")
def catalog_list(spark, d):
    return relational.listed(_catalog(spark, d)).select("document_id", "name", "created_at")


@query(f"SELECT document_id, name FROM ({_CATALOG_SQL}) WHERE document_id NOT IN (SELECT doc_id::VARCHAR FROM labels)")
def catalog_remove(spark, d):
    return relational.without(_catalog(spark, d), _read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id"))).select("document_id", "name")


@query("SELECT doc_id::VARCHAR AS document_id FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)")
def catalog_exists(spark, d):
    return relational.existing(_read(spark, d, "labels").select(F.col("doc_id").cast("string").alias("document_id")), _catalog(spark, d))


@query(f"SELECT document_id, name, state, created_at AS uploaded_at FROM ({_CATALOG_SQL})")
def documents_view(spark, d):
    return relational.documents_view(_catalog(spark, d))


@query("SELECT vec_id::VARCHAR AS document_id, coalesce(doc_id || '.txt', 'belge') AS name FROM embeddings LEFT JOIN (SELECT * FROM documents WHERE source <> 'src0') ON doc_id = vec_id")
def source_names(spark, d):
    catalog = _catalog(spark, d).join(_read(spark, d, "documents").filter("source <> 'src0'").select(F.col("doc_id").cast("string").alias("document_id")), "document_id", "left_semi")
    return relational.source_names(_read(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("document_id")), catalog).select("document_id", "name")


@query("SELECT (SELECT count(*) FROM documents) AS documents, (SELECT count(*) FROM embeddings) AS chunks, (SELECT count(DISTINCT l_suppkey) FROM lineitem) AS nodes, (SELECT count(*) FROM events) AS events")
def archive_stats(spark, d):
    return relational.stats(documents=_catalog(spark, d), chunks=_read(spark, d, "embeddings"), nodes=_read(spark, d, "lineitem").select("l_suppkey").distinct(), events=_read(spark, d, "events"))


@query("SELECT s_name AS label FROM supplier UNION ALL SELECT n_name FROM nation ORDER BY 1")
def entities_view(spark, d):
    return _read(spark, d, "supplier").select(F.col("s_name").alias("label")).unionAll(_read(spark, d, "nation").select("n_name")).orderBy("label")


@query("SELECT event_id AS seq, event_type AS action FROM events ORDER BY event_id DESC")
def audit_view(spark, d):
    return _read(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("event_type").alias("action")).orderBy(F.desc("seq"))


_STATES = [("a", 1, "PARSING"), ("a", 2, "PARSED"), ("a", 3, "ARCHIVED"), ("b", 1, "PARSED"), ("c", 1, "FAILED"), ("c", 2, "RECEIVED"), ("c", 3, "PARSING"), ("d", 1, "PARSING"), ("d", 2, "RECEIVED")]


@query("SELECT * FROM (VALUES ('a', 1, 'RECEIVED', true), ('a', 2, 'PARSING', true), ('a', 3, 'PARSED', true), ('b', 1, 'RECEIVED', false), ('c', 1, 'RECEIVED', true), ('c', 2, 'FAILED', true), ('c', 3, 'RECEIVED', true), ('d', 1, 'RECEIVED', true), ('d', 2, 'PARSING', false)) AS v(document_id, seq, state, legal)")
def state_machine(spark, d):
    return relational.checked_log(_values(spark, _STATES, "document_id string, seq int, target string")).select("document_id", "seq", "state", "legal")


@query("SELECT count(DISTINCT text) AS misses, count(*) - count(DISTINCT text) AS hits FROM conversations WHERE text IS NOT NULL")
def llm_cache_accounting(spark, d):
    return relational.cache_accounting(_read(spark, d, "conversations").filter("text is not null").select(F.col("text").alias("key")))


_URIS = ["a/b.TXT", "c.pdf", "d.docx", "e.png", "noext", "x.tar.txt"]


@query(f"SELECT x, CASE lower(regexp_extract(x, '\\.([^./]+)$', 1)) WHEN 'txt' THEN 'text' WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' END AS loader, regexp_replace(regexp_replace(x, '^.*/', ''), '(.)\\.[^.]*$', '\\1') AS title FROM (VALUES {_sql(_URIS)}) AS v(x)")
def load_route(spark, d):
    return _values(spark, _URIS).select("x", loaders.route(F.col("x")).alias("loader"), loaders.title(F.col("x")).alias("title"))


