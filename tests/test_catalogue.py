"""A sample of the catalogue against its SQL, and the catalogue's shape."""

from pathlib import Path

import duckdb
import pytest

from copse.plans import catalogue

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def test_every_oracle_has_a_query():
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())
    assert len(catalogue.oracle_sql()) >= 75


@pytest.mark.parametrize("name", ["grad_softmax", "grad_cox", "metric_aucpr", "metric_ndcg", "bin_assign", "split_best", "split_monotone", "hist_root", "hist_level1", "hist_subtraction", "split_backward_missing", "split_onehot", "split_partition", "leaf_values", "boost_round_1", "tree_hist", "tree_exact", "tree_lossguide", "shap_fixed_tree", "importance_gain", "prune_fixed_tree", "tree_dart", "tree_approx", "softprob_round_1", "linear_round_1", "linear_batches_round_1", "linear_sparse_round_1", "tree_exact_continuous", "tree_sparse", "grad_rank_unbiased", "rank_pairs_mean", "sample_threshold", "source_column_pages", "custom_loss_round_1", "model_document", "model_table", "predict_strict_leaf", "predict_inplace"])
def test_oracle(spark, sql, name):
    got = catalogue.queries()[name](spark, SMALL)
    columns = sorted(got.columns)
    want = sql.execute(catalogue.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    tidy = lambda v: round(v, 9) if isinstance(v, float) else v
    a = sorted([tuple(tidy(r[c]) for c in columns) for r in got.collect()], key=str)
    b = sorted([tuple(tidy(r[names.index(c)]) for c in columns) for r in want.fetchall()], key=str)
    assert a == b
