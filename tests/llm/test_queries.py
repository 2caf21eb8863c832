"""The queries of the subpackage on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tests.compare import connect, differences, plan_of
from viario.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
NATIVE = {"op3_quality", "op10_licenses"}
COLUMNS = {
    "op3_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
    "op4_simhash": "doc_id fingerprint component_id",
    "op5_scoring": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op6_language": "doc_id held_out lang_pred score",
    "op7_toxicity": "doc_id held_out score predicted",
    "op11_exact": "doc_id keep_id group_size kept text_sha256",
    "op12_divergence": "lang source part item value rank",
    "op13_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, FOLDER)
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BatchEvalPython" not in plan
    if name in NATIVE:
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert set(COLUMNS.get(name, "doc_id conv_id").split()) & set(df.columns)
    assert set(COLUMNS.get(name, "").split()) <= set(df.columns)
    if name in SQL:
        assert differences(df, con, SQL[name]) is None
    else:
        assert df.count() >= 200


def test_contract():
    names = contract.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13 and "pipeline" in names
