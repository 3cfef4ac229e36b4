"""Registered queries against their SQL, and the pipeline stage by stage."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline
import public_tokenizers
import pytest
from oracle import assert_same
from test_files import expected_tokens
from test_near_dup import brute_force
from tokenizers import Tokenizer

import __spark_entry__
from quillon.llm import decontaminate, mixing, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    assert assert_same(queries.QUERIES[name](spark, "/root/testdata/sf0.01"), queries.ORACLE_SQL[name], "/root/testdata/sf0.01")


def test_all_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in names if n in queries.QUERIES}
    assert names >= {*queries.QUERIES, "pipeline"} and set(__spark_entry__.oracle_sql()) <= names


COLUMNS = {
    "op1_html_text": "page_id url text n_chars", "op2_token_output": "doc_id start n_tokens ids_crc32",
    "op5_language": "doc_id held_out lang_pred score", "op6_mixing": "doc_id source size source_size target taken",
    "op7_fingerprint": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op8_quality": "doc_id held_out score predicted", "op9_decontaminate": "doc_id item_id edits item_words start end",
    "op10_lm_scores": "doc_id held_out n_tokens n_known base_score score train_tokens",
    "op11_merkle": "doc_id leaf subroot root proof_sha256 folded_root verified", "op13_substring": "doc_id n_words n_removed kept_sha256",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_results_are_whole(spark, name):
    out = queries.QUERIES[name](spark, SF)
    assert out.columns == COLUMNS[name].split()
    if name != "op9_decontaminate":
        table = "pages" if name == "op1_html_text" else "documents"
        assert out.count() == queries.table(spark, SF, table).count()


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What goes into each stage, and what comes out of the last one."""
    at = tmp_path_factory.mktemp("stages")
    out = [queries.table(spark, SF, "documents")]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(f"{at}/{k}")
        out.append(spark.read.parquet(f"{at}/{k}"))
    return out


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_all_stages_but_the_last_keep_the_columns(stages):
    assert all(x.columns == stages[0].columns for x in stages[:-1])
    assert all(Counter(map(hash, rows(b))).keys() <= Counter(map(hash, rows(a))).keys() for a, b in zip(stages[:-2], stages[1:-1]))


def test_quality_stage_rejects_what_the_operator_predicts(spark, stages):
    labels = queries.table(spark, SF, "labels")
    good = {r.doc_id for r in quality.quality_scores(stages[0], labels).collect() if r.predicted}
    assert sorted(rows(stages[1])) == sorted(r for r in rows(stages[0]) if r[0] in good)


def test_one_of_each_group_stays(stages):
    want = brute_force([(r.doc_id, r.text) for r in stages[1].collect()])
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(d for d, (_, _, kept) in want.items() if kept)


def test_leaking_documents_go(spark, stages):
    leaks = {r.doc_id for r in decontaminate.find_leaks(stages[2], queries.table(spark, SF, "benchmark")).collect()}
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted({r.doc_id for r in stages[2].collect()} - leaks)


def test_the_mix_repeats_documents(stages):
    want = {r.doc_id: r.copies for r in mixing.mix(stages[3]).collect() if r.copies}
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_token_files_hold_all_that_is_left(stages):
    plain = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    want = expected_tokens(plain, [(r.doc_id, r.text) for r in stages[4].collect()])
    assert sorted(rows(stages[5]), key=lambda r: r[1]) == want


def test_run_is_the_stages(spark, stages):
    assert sorted(rows(corpus_pipeline.run(spark, SF))) == sorted(rows(stages[5]))
