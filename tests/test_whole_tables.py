"""The queries over whole tables that SQL can't follow, against brute force."""

import heapq
import math
import re
import unicodedata
from collections import Counter

import pyarrow.parquet as pq
import pytest

from lexweave import catalogue
from lexweave.operators import entities, pii_tr

DATA = "/root/testdata"
PLANTED = [(10_000 + i, text) for i, (_, _, text) in enumerate(catalogue._LETTERS)] + [
    (10_000, "aynı numara, başka metin: veli@example.org ve 05321234567"), (None, "numarasız: ali@example.com"),
    (10_010, "uzun " * 20_000 + "10000000146, ali@example.com, TR330006100519786457841326"), (10_011, "0 532 123 45 67; 0532.123.45.67; 10000000145"),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("whole"))
    docs = pq.read_table(f"{DATA}/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in docs] + PLANTED
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{at}/documents.parquet")
    return at, rows


def tckn(x):
    n = [int(c) for c in x]
    return n[0] > 0 and ((sum(n[0:9:2]) * 7 - sum(n[1:8:2])) % 10, sum(n[:10]) % 10) == (n[9], n[10])


def brute(rows):
    """(doc_id, text) masked document by document; the vault in order; hits by document and type."""
    vault, hits, masked = {}, Counter(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        text = text or ""
        for k, (kind, pattern) in enumerate(pii_tr.PASSES):

            def put(m, k=k, kind=kind, i=i):
                if k == pii_tr.CHECKED and not tckn(m[2]):
                    return m[0]
                value = m[2].replace(" ", "") if kind == "IBAN" else m[2]
                hits[i, kind] += 1
                own = vault.setdefault((kind, value), (f"[{kind}_{1 + sum(t == kind for t, _ in vault)}]", i))
                return m[1] + own[0]

            text = re.sub(pattern.removeprefix("(?U)"), put, text)
        masked.append((i, text))
    return masked, vault, hits


def test_documents_are_masked_numbered_and_audited(spark, folder):
    at, rows = folder
    run = lambda name: [tuple(r) for r in catalogue.queries()[name](spark, at).collect()]
    # values of the two texts of document 10000 are of different types, so that their order doesn't count
    masked, vault, hits = brute(rows)
    got = run("pii_redact_documents")
    assert sorted(got, key=repr) == sorted(masked, key=repr)
    assert {(t, p, s) for t, p, _, s in run("pii_vault_documents")} == {(t, p, s) for (t, _), (p, s) in vault.items()}
    assert {(i, t): n for i, t, n in run("pii_detect_types")} == dict(hits) and {t for _, t in hits} == {"IBAN", "TCKN", "VKN", "EMAIL", "PHONE"}
    audit = sorted(run("audit_log_documents"))
    assert [s for s, _, _ in audit] == list(range(1, len(vault) + 1)) and {(t, p) for _, t, p in audit} == {(t, p) for (t, _), (p, _) in vault.items()}


def dropped(x):
    name = x.strip().strip(",;:.").strip("\"'«»")
    low = name.translate(str.maketrans("Iİ", "ıi")).lower()
    own, flat = low.split(), low.translate(entities._TABLE)
    folded = lambda values: {v.translate(entities._TABLE) for v in values}
    upper = "A-ZÇĞİÖŞÜ"
    forms = (r"\[?[A-Z]+_[0-9]+\]?", r"[0-9]{11}", r"(?i:TR)[\s0-9]{10,}", rf"[{upper}]{{2,}}[-/][{upper}0-9]+([-/][{upper}0-9]+)*", r"[0-9\s.,:/()-]+")
    return (
        len(name) < 2 or any(re.fullmatch(f, name) for f in forms) or ":" in name or any(re.fullmatch(r"[0-9]{6,}", w) for w in own) or any(w in entities.IDENTITY for w in own)
        or len(own) > 5 or own[0] in entities.GREETING + entities.GENERAL_FIRST or flat in folded(entities.PLACES) or any(w in entities.ADDRESS + entities.MONTHS for w in own)
        or own[-1] in entities.GENERAL_LAST or len(own) == 1 and flat in folded(entities.GENERAL_ALONE) or not any(unicodedata.category(c)[0] == "L" for c in name)
    )


def test_every_name_and_word_of_the_conversations_is_filtered(spark):
    turns = Counter()
    for text in pq.read_table(f"{DATA}/sf0.001/conversations.parquet")["text"].to_pylist():
        word = r"[A-ZĞÜŞİÖÇ][\wğüşıöç]+"
        turns.update(set(text.split()) | set(re.findall(rf"\b({word}(?:\s+{word})*)\b", text)))
    got = {r["x"]: (r["turns"], r["kept"]) for r in catalogue.queries()["entity_filter_turns"](spark, f"{DATA}/sf0.001").collect()}
    assert got == {x: (n, int(not dropped(x))) for x, n in turns.items()} and {k for _, k in got.values()} == {0, 1}


def test_path_through_the_large_graph_of_parts(spark):
    orders = {}
    for r in pq.read_table(f"{DATA}/sf0.01/lineitem.parquet", columns=["l_orderkey", "l_partkey", "l_linenumber"]).to_pylist():
        own = orders.setdefault(r["l_orderkey"], {})
        own[r["l_partkey"]] = min(own.get(r["l_partkey"], 99), r["l_linenumber"])
    last = {}
    for o, own in orders.items():
        for a, n in own.items():
            for b in own:
                if a != b:
                    last[a, b] = max(last.get((a, b), (0, 0)), (o * 100 + n, o))
    out = {}
    for (a, b), (_, o) in last.items():
        out.setdefault(a, {})[b] = 0.5 if o % 7 else 0.8
    assert len(last) > 200_000  # the branch for large graphs
    start, end = min(out), max(out)
    best, queue = {}, [(0.0, start)]
    while queue:
        cost, a = heapq.heappop(queue)
        if a not in best:
            best[a] = cost
            for b, chance in out[a].items():
                heapq.heappush(queue, (cost - math.log(chance), b))
    row = catalogue.queries()["connection_path_parts"](spark, f"{DATA}/sf0.01").first()
    nodes, relations = [int(x.removeprefix("Part ")) for x in row["nodes"].split("|")], row["relations"].split("|")
    steps = [out[a][b] for a, b in zip(nodes, nodes[1:])]
    assert row["found"] and (nodes[0], nodes[-1]) == (start, end) and relations == ["supplied" if c == 0.8 else "" for c in steps]
    assert math.isclose(-sum(map(math.log, steps)), best[end]) and math.isclose(row["confidence"], math.exp(-best[end]), abs_tol=5e-5)
