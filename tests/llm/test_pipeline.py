import corpus_pipeline
import pytest

import brute
from dyadspark.llm import toxicity


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The documents each stage gives, by name, each stage on what the one before kept."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
        out[name] = docs
    return out


def rows(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages_are_the_five_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "toxicity", "ngram_jaccard_join", "substring_dedup", "benchmark_decontamination", "piece_codec"]


def test_all_but_the_last_keep_the_columns(stages):
    columns = stages["documents"].columns
    assert all(stages[n].columns == columns for n, _ in corpus_pipeline.STAGES[:-1])


def test_toxic_documents_go(spark, folder, stages):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    predicted = {r.doc_id: r.predicted for r in toxicity.toxicity(stages["documents"], labels).collect()}
    assert set(rows(stages["toxicity"])) == {d for d, p in predicted.items() if not p}


def test_one_document_of_each_group_stays(stages):
    before = rows(stages["toxicity"])
    groups = brute.jaccard_components(before.items())
    assert rows(stages["ngram_jaccard_join"]) == {d: t for d, t in before.items() if groups[d][1] == d}


def test_repeats_are_cut(stages):
    before, after = rows(stages["ngram_jaccard_join"]), rows(stages["substring_dedup"])
    assert after == {d: t for d, (t, _) in brute.dedup_units(before.items()).items()}
    assert {r.doc_id: r.n_chars for r in stages["substring_dedup"].collect()} == {d: len(t) for d, t in after.items()}


def test_documents_with_test_items_go(spark, folder, stages):
    items = [brute.bench_words(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    before, after = rows(stages["substring_dedup"]), rows(stages["benchmark_decontamination"])
    assert set(after.items()) <= set(before.items())
    for d in [d for d in before if d not in after or d % 4 == 0]:
        words = brute.bench_words(before[d])
        assert (d in after) == all(brute.smith_waterman(q, words) < len(q) for q in items if q)


def test_the_run_is_the_stages_one_after_another(spark, folder, stages):
    want = sorted((r.doc_id, r.ids, r.decoded) for r in stages["piece_codec"].collect())
    assert sorted((r.doc_id, r.ids, r.decoded) for r in corpus_pipeline.run(spark, folder).collect()) == want
    assert {d: t for d, _, t in want} == rows(stages["benchmark_decontamination"])
