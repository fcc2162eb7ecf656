import pytest

from tests.helpers import DATA, database, same
from topicmill.plans.oracles import ORACLES
from topicmill.plans.queries import QUERIES

FREE = {"kmeans_grid", "best_clustering", "encode_text"}


def test_every_query_has_sql():
    assert set(QUERIES) - set(ORACLES) == FREE


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, DATA).toPandas(), database().sql(ORACLES[name]).df())


def test_encode_text_is_of_unit_length(spark):
    found = QUERIES["encode_text"](spark, DATA).toPandas()
    assert len(found) == 200 and ((found.norm2 - 1).abs() < 1e-4).sum() + (found.norm2 == 0).sum() == 200


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_registered_kmeans_runs_until_settled(spark, monkeypatch):
    from topicmill.operators import clustering

    seen, fit = [], clustering.kmeans_groups

    def spy(points, keys, ks, seed=42, max_iter=300, tol=1e-4):
        seen.append((max_iter, tol))
        return fit(points, keys, ks, seed, max_iter, tol)

    monkeypatch.setattr(clustering, "kmeans_groups", spy)
    for name in ("kmeans_grid", "best_clustering"):
        assert QUERIES[name](spark, DATA).count() > 0
    assert seen == [(300, 1e-4)] * 2
