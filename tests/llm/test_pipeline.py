"""The pipeline's stages, each on its predecessor's result."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
import pytest

from tandemql.llm import tokens


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(spark.createDataFrame([(10**6, None, "en", "src0", 0), (10**6 + 1, "漢字 " * 50, "zz", "src0", 150)], "doc_id long, text string, lang string, source string, n_chars long"))
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{base}/{i}")
        out.append(spark.read.parquet(f"{base}/{i}"))
    return out


def ids(df):
    return [r.doc_id for r in df.select("doc_id").collect()]


def test_stages_keep_the_columns_and_clean_documents(stages):
    docs, known, single, clean, mixed, last = stages
    assert [len(s) for s in (corpus_pipeline.STAGES, stages)] == [5, 6]
    for df in stages[1:5]:
        assert df.columns == docs.columns
    assert set(ids(docs)) - set(ids(known)) >= {10**6} and len(set(ids(docs)) - set(ids(known))) <= 2
    assert set(ids(single)) < set(ids(known)) and len(ids(single)) == len(set(ids(single)))
    assert set(ids(clean)) < set(ids(single)) and len(ids(clean)) > 0.9 * len(ids(single))
    assert set(ids(mixed)) <= set(ids(clean))
    assert len(ids(last)) == len(ids(mixed))


def test_mixed_texts_are_tokenised(stages):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))
    total = sum(len(e.ids) + 1 for e in whole.encode_batch([r.text for r in stages[4].collect()], add_special_tokens=False))
    assert total == sum(r.n_tokens for r in stages[5].collect())


def test_run_equals_the_stages(spark, sf_dir):
    once = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert once and once == sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))


def test_empty_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0
