"""``run`` against stage-by-stage references: SQL where there is some, brute
force for the fingerprints, the classifier's own per-document scores."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline as cp
from tests.conftest import SMOKE
from tests.llm.helpers import union_all, words
from tests.llm.test_simhash import brute_print
from vendora.llm import quality
from vendora.llm.sql import ORACLE_OP1, ORACLE_OP4, ORACLE_OP8

COLS = ["doc_id", "text", "lang", "source", "n_chars"]


def sql(query: str, docs: pd.DataFrame) -> pd.DataFrame:
    con = duckdb.connect()
    con.register("documents", docs)
    con.execute(f"CREATE VIEW benchmark AS SELECT * FROM read_parquet('{SMOKE}/benchmark.parquet')")
    return con.sql(query).df()


def same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols
    key = lambda d: sorted(map(repr, d[cols].astype(object).where(d[cols].notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage, as the pipeline passes them on."""
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    out = {}
    for name, stage in cp.STAGES:
        rows = docs.toPandas()
        docs = cp.stored(stage(spark, docs, SMOKE), f"test-{name}")
        out[name] = (rows, docs.toPandas())
    return out


def test_stage_names_and_columns(stages):
    assert [n for n, _ in cp.STAGES] == ["quality", "line_dedup", "simhash", "decontaminate", "mix"]
    for name in ("quality", "line_dedup", "simhash", "decontaminate"):
        assert list(stages[name][1].columns) == COLS
        assert 0 < len(stages[name][1]) <= len(stages[name][0])


def test_quality_keeps_what_is_predicted(spark, stages):
    before, after = stages["quality"]
    labels = spark.read.parquet(f"{SMOKE}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{SMOKE}/documents.parquet"), labels)
    import numpy as np
    scores = model.score(np.array([quality.statistics(t) for t in before.text]))
    same(after, before[scores >= 0.3])


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    kept = sql(ORACLE_OP8, before).merge(before.drop(columns="text"), on="doc_id")
    kept = kept[[not (n and not words(t)) for n, t in zip(kept.n_dropped, kept.text)]]
    kept["n_chars"] = [len(t) if n else c for n, t, c in zip(kept.n_dropped, kept.text, kept.n_chars)]
    same(after, kept[COLS])


def test_simhash_keeps_one_of_each_group(stages):
    before, after = stages["simhash"]
    prints = [brute_print(t) for t in before.text]
    near = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 2]
    ids = before.doc_id.tolist()
    roots = union_all(len(ids), near)
    first = {r: min(d for d, q in zip(ids, roots) if q == r) for r in set(roots)}
    same(after, before[before.doc_id.isin(first.values())])


def test_decontaminate(stages):
    before, after = stages["decontaminate"]
    bad = sql(ORACLE_OP1, before)
    same(after, before[~before.doc_id.isin(bad.doc_id[bad.contaminated])])


def test_mix(stages):
    before, after = stages["mix"]
    same(after, sql(ORACLE_OP4, before))


def test_run_equals_its_stages(spark, stages):
    same(cp.run(spark, SMOKE).toPandas(), stages["mix"][1])


def test_empty_documents_with_other_columns(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet").limit(0).selectExpr("*", "1 as copy", "'x' as w", "2 as score")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, SMOKE)
        assert docs.columns == [*COLS, "copy", "w", "score"]
    assert cp.STAGES[-1][1](spark, docs, SMOKE).count() == 0
