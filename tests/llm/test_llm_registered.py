"""The registered queries against SQL where there is some, and the pipeline stage by stage against brute force."""

import base64
import hashlib
import os

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from test_llm_dedup import contamination, fingerprint, paragraph_removals, roots
from test_llm_models import base, distributions

import __spark_entry__
import corpus_pipeline
from chronoweave.llm import common, paragraphs, quality_rules
from chronoweave.llm.queries import QUERIES


@pytest.mark.parametrize("name", [n for n, (_, text) in QUERIES.items() if text])
def test_query_equals_sql(spark, small, name):
    con = duckdb.connect()
    for f in os.listdir(small):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{small}/{f}'")
    run, text = QUERIES[name]
    frame, want = run(spark, small), con.sql(text)
    order = sorted(frame.columns)
    assert order == sorted(want.columns)
    assert sorted(map(tuple, frame.select(*order).collect())) == sorted(want.select(*order).fetchall())


def test_entry_registers_all():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert __spark_entry__.oracle_sql().keys() <= names.keys()


def test_pipeline_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text, r.lang) for r in docs.orderBy("doc_id").collect()]

    def step(k, frame):
        out = common.stored(corpus_pipeline.STAGES[k][1](spark, frame, small), "step")
        assert k == 4 or out.columns == columns
        return out

    judge = quality_rules.Judge(distributions(rows))
    kept = [(d, t) for d, t, _ in rows if not base(t)[-1] and judge.within(t.encode().lower().split(), quality_rules._counts(t.encode())[0])]
    docs = step(0, docs)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == kept

    prints = [fingerprint(t) for _, t in kept]
    of = roots(len(kept), [(i, j) for i in range(len(kept)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    kept = [row for i, row in enumerate(kept) if of[i] == i]  # rows are in order: a root is its component's first
    docs = step(1, docs)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == kept

    gone = paragraph_removals(kept)
    kept = [(d, paragraphs.without(t.encode(), [k for k, _ in gone.get((d, t), [])]).decode()) for d, t in kept]
    docs = step(2, docs)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == kept

    kept = [row for row, verdict in zip(kept, contamination(kept, items), strict=True) if not verdict[-1]]
    docs = step(3, docs)
    assert sorted((r.doc_id, r.text) for r in docs.collect()) == kept

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for d, t in kept:
        ids = np.array(library.encode_ordinary(t), "<u4")
        want.append((d, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, step(4, docs).collect())) == want
    assert sorted(map(tuple, corpus_pipeline.run(spark, small).collect())) == want


def test_pipeline_of_nothing_and_of_odd_rows(spark, tmp_path):
    import corpus

    for name, rows in (("none", []), ("odd", corpus.ROWS)):
        folder = f"{tmp_path}/{name}"
        corpus.docs(spark, rows).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
        out = corpus_pipeline.run(spark, folder)
        assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() <= len(rows)


@pytest.mark.parametrize("name", list(QUERIES))
def test_queries_of_an_empty_table(spark, tmp_path, name):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES[name][0](spark, str(tmp_path)).count() == 0
