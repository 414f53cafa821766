"""The pipeline on planted rows against brute force, and the SQL of the training-data operators."""

import os
import re

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from lexweave.llm import common, minhash, queries

DATA = "/root/testdata/sf0.001"


def test_training_operators_equal_their_sql(spark):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    for name, sql in queries.oracle_sql().items():
        got = queries.queries()[name](spark, DATA)
        want = con.execute(f"SELECT {', '.join(got.columns)} FROM ({sql})").fetchall()
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Toxic texts are told by one word of the labelled ones; clean texts, copies, near copies and personal data beside them."""
    at, r = str(tmp_path_factory.mktemp("pipeline")), np.random.default_rng(8)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ba", "den", "fir", "gol", "hum", "jat", "pek", "tov")]
    text = lambda n: " ".join(r.choice(words, n))
    rows = [(i, f"{text(12)} {'you stupid idiot ' * 4 if i % 2 else ''}{text(12)}") for i in range(400)]
    labels = [(i, 1, i % 2) for i in range(400)]
    one, two = text(80), text(80)
    rows += [
        (1000, "you stupid idiot " * 8), (1001, one), (1002, re.sub(" ", "  ", one)), (1003, two), (1004, two + " extra"), (1005, "ask a.b@site.org or 10.0.0.255 or 4111 1111 1111 1111 about " + text(20)),
        (1006, "ask a.b@site.org  or 10.0.0.255 or 4111 1111 1111 1111 about " + text(20)), (1007, ""), (1008, None),
    ]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, rows


def test_stages_take_effect_on_each_others_output(spark, folder):
    at, rows = folder
    left = {i: t or "" for i, t in rows if i < 1000 and i % 2 == 0 or i > 1000}  # toxic: the odd ones and 1000
    groups = {}
    for i, t in left.items():
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t), []).append((-len(t), i))
    left = {i: left[i] for g in groups.values() for _, i in [min(g)]}
    assert 1001 not in left and 1002 in left and (1007 in left) != (1008 in left)
    sets = {i: set(minhash.shingles(t).tolist()) for i, t in left.items()}
    near = {b for a in left for b in left if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert near == {1004}
    left = {i: t for i, t in left.items() if i not in near}
    for pattern, name in ((r"[\w.]+@site\.org", "[EMAIL]"), (r"10\.0\.0\.255", "[IP]"), (r"4111 1111 1111 1111", "[CARD]")):
        left = {i: re.sub(pattern, name, t) for i, t in left.items()}
    library = Tokenizer.from_file(common.tokenizer_path())
    want = {i: len(library.encode(t, add_special_tokens=False).ids) + 1 for i, t in left.items()}
    got = {}
    for row in corpus_pipeline.run(spark, at).collect():
        got[row["doc_id"]] = got.get(row["doc_id"], 0) + row["length"]
    assert got == want
