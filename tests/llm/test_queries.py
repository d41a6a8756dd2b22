"""The registered queries: against their SQL, the contracts' columns, and that
they read whole tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as se
from tests.conftest import SMOKE
from vendora.llm.queries import ORACLE, QUERIES

TABLES = ["documents", "embeddings", "pages", "benchmark", "labels", "conversations"]
COLUMNS = {
    "op1": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["doc_id", "fingerprint", "component_id"],
    "op5": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op6": ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"],
    "op7": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op9": ["vec_id", "n_links", "component_id", "kept"],
    "op10": ["page_id", "host", "path", "rule", "verdict"],
    "op11": ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
    "op12": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op13": ["lang", "source", "part", "item", "value", "rank"],
}


def values(df: pd.DataFrame) -> list:
    return sorted(tuple("null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v) for v in row)
                  for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck_llm():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMOKE}/{t}.parquet')")
    return con


def test_one_query_per_operator_is_registered():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(se.queries())
    assert set(ORACLE) <= set(se.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck_llm, name):
    df = QUERIES[name](spark, SMOKE)
    wanted = COLUMNS.get(name.split("_")[0], [])
    assert df.columns[:len(wanted)] == wanted
    got = df.toPandas()
    whole = {"op5": "conversations", "op9": "embeddings", "op10": "pages"}.get(name.split("_")[0], "documents")
    key = got.columns[0]
    ids = {r[0] for r in duck_llm.sql(f"SELECT DISTINCT {key} FROM {whole}").fetchall()}
    if name.startswith("op5"):
        ids.add(-7)
    assert set(got[key]) <= ids and (name.startswith("op4_") or (set(got[key]) == ids and len(got) >= len(ids)))
    if name in ORACLE:
        want = duck_llm.sql(ORACLE[name]).df()
        assert sorted(want.columns) == sorted(got.columns)
        assert values(got) == values(want)
