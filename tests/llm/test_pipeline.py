"""Every stage on its own input against a plain version."""

import brute
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline as P
from percolith.llm import bpe


@pytest.fixture(scope="module")
def folder():
    return "/root/testdata/sf0.001"


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(P.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, folder)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r.asDict() for r in docs.collect()}
        texts = [(r["doc_id"], r["text"]) for r in before]
        if name != "bpe":
            assert docs.columns == P.COLUMNS
        if name == "language_id":
            assert set(after) == {i for i, t in texts if t and any(c.isalpha() for c in t)}
        elif name == "line_dedup":
            for i, n, removed, _, digest in brute.op8(texts):
                if removed == n and n:
                    assert i not in after
                else:
                    assert brute.sha(after[i]["text"] or "") == digest and after[i]["n_chars"] == len(after[i]["text"] or "")
        elif name == "near_dup":
            assert set(after) == {i for i, _, c, kept in brute.op5(texts, 80) if kept}
        elif name == "decontaminate":
            assert set(after) == {r[0] for r in brute.op9(texts, items) if not r[5]}
        else:
            tokens = bpe.tokenizer(public_tokenizers.path("word_bpe_49k.json"))
            for i, t in texts:
                ids = tokens.encode(t or "", add_special_tokens=False).ids
                assert after[i]["ids_sha256"] == brute.sha(np.array(ids, "<u4").tobytes()) and after[i]["decoded_sha256"] == brute.sha(tokens.decode(ids, skip_special_tokens=False))
            assert len(after) == len(texts)


def test_empty_documents_and_rows_of_nulls(spark, folder):
    """Every stage on an empty table, on rows of nothing but nulls, and with further columns of clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, component string, kept string, `_id` string"
    for rows in ([], [(None,) * 9, (None,) * 9], [(1, "", None, None, 0, "x", "y", "z", "w")]):
        docs = spark.createDataFrame(rows, schema)
        for name, stage in P.STAGES:
            out = stage(spark, docs, folder)
            if name == "bpe":
                assert out.count() == len(rows)
            else:
                assert out.columns == P.COLUMNS and out.count() in (0, len(rows))


def test_planted_languages(spark, folder):
    """Texts in a learned script that are like no profile go; clean ones stay."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").select(*P.COLUMNS)
    first = docs.where("text is not null and n_chars > 200").limit(5).collect()
    odd = [(900_001, "zzxqj qxzzj jqxzx " * 60, None, "s", 1), (900_002, "日本語の文章です " * 40, None, "s", 1), (900_003, "!!! 12 ???", None, "s", 1)]
    out = {r.doc_id for r in P.identify_language(spark, docs.union(spark.createDataFrame(odd, docs.schema)), folder).collect()}
    assert not out & {k for k, *_ in odd} and {r.doc_id for r in first} <= out
