"""Every operator on odd rows, on empty tables, and beside columns with its own names."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kinelake.llm import decontaminate, line_dedup, lm_score, quality_model, quality_rules, secrets, sentencepiece_trie, simhash, toxicity, trees
from kinelake.llm.common import is_fold
from kinelake.llm.queries import oracle_sql, queries

MODEL = toxicity.Model(["bad"], __import__("numpy").array([2.0]), 0.1, 1.0, 0.1, __import__("numpy").array([-3.0, 5.0, 1.0]))


def forest():
    import numpy as np

    return trees.fit(np.zeros((0, len(quality_model.FEATURES))), np.zeros(0))


def bench(spark, rows=((1, "two three four five six seven eight nine ten eleven"), (2, None), (None, "one two"), (3, ""))):
    return spark.createDataFrame(list(rows), "item_id long, text string")


OPERATORS = {
    "line_dedup": lambda s, d: line_dedup.drop_boilerplate(d, F.col("source")),
    "quality_model": lambda s, d: quality_model.score(d, forest()),
    "quality_rules": lambda s, d: quality_rules.judged(d),
    "toxicity": lambda s, d: toxicity.score(d, MODEL),
    "fingerprints": lambda s, d: simhash.fingerprints(d),
    "near_duplicates": lambda s, d: simhash.near_duplicates(d),
    "decontaminate": lambda s, d: decontaminate.decontaminate(d, bench(s)),
    "secrets": lambda s, d: secrets.find(d),
    "lm_score": lambda s, d: lm_score.score(d, is_fold("doc_id", 7, 2)),
    "encode": lambda s, d: sentencepiece_trie.encode(d, sentencepiece_trie.load(s), check=True),
    "decode": lambda s, d: sentencepiece_trie.decode(d.withColumn("ids", F.lit(None).cast("array<int>")), sentencepiece_trie.load(s)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_stay(spark, odd, name):
    assert OPERATORS[name](spark, odd).count() == odd.count()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, empty, name):
    assert OPERATORS[name](spark, empty).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_with_the_operators_names_give_way(spark, odd, name):
    plain = OPERATORS[name](spark, odd)
    added = [c for c in plain.columns if c not in odd.columns]
    clashing = odd.withColumns({c: F.lit("mine") for c in [*added, "other", "_text", "_site"]})
    out = OPERATORS[name](spark, clashing)
    assert len({c.lower() for c in out.columns}) == len(out.columns)
    assert set(plain.columns) <= set(out.columns)
    compared = [c for c in plain.columns if dict(plain.dtypes)[c] not in ("double",)]
    assert out.select(compared).count() == odd.count()
    assert sorted(map(repr, out.select(compared).collect())) == sorted(map(repr, plain.select(compared).collect()))


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, odd, empty, tmp_path, stage):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, empty):
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns)
        assert out.count() <= docs.count()
    if stage is not corpus_pipeline.STAGES[-1][1]:
        assert stage(spark, odd, str(tmp_path)).columns == odd.columns


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]], ids=[n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_the_callers_columns(spark, odd, tmp_path, stage):
    """Whatever the columns are called, they come back with their own values."""
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    names = "_text _lines _id _rest _made n_words kept n_lines n_dropped spans ids items n_hit row runs fp site component_id hash keys sketch base suspect".split()
    more = odd.withColumns({c: F.lit(f"mine {c}") for c in names})
    plain, out = stage(spark, odd, str(tmp_path)), stage(spark, more, str(tmp_path))
    assert out.columns == more.columns
    assert all(r[c] == f"mine {c}" for r in out.collect() for c in names)
    assert sorted(map(repr, out.select(*odd.columns).collect())) == sorted(map(repr, plain.collect()))


def test_models_learn_from_odd_labels(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 1), (4, 0, 0), (4, 1, 0), (6, 1, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    for docs in (odd, empty):
        for these in (labels, labels.limit(0)):
            assert quality_model.score(docs, quality_model.train(docs, these)).count() == docs.count()
            assert toxicity.score(docs, toxicity.train(docs, these)).count() == docs.count()


def test_without_labels_nothing_is_toxic(spark, odd):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(odd, toxicity.train(odd, none)).collect()} == {0}


def test_one_query_for_each_operator():
    names = sorted(queries(), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert set(oracle_sql()) <= set(names)


def test_filters_on_results_are_not_pushed_below_them(spark, odd):
    """Such a filter would repeat shared expressions without end."""
    assert quality_rules.judged(odd).where("NOT base_failed AND kept AND word_distance < 1").count() <= odd.count()
    assert secrets.find(odd).where("size(spans) > 0").count() == 0
