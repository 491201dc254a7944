import pytest
from oracle import compare

import __spark_entry__
from codeloom.jobs import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, name):
    compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_fits_have_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_points(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_windows_of_whole_histories(spark):
    n = {r["user_id"]: len(r["seq"]) for r in catalog.sequences(spark, SF).collect()}
    want = sorted((u, a, b) for u, k in n.items() for b in range(2, k + 1) for a in range(b - 1))
    for name in ("contiguous_subsequences", "contiguous_subsequences_whole"):
        found = catalog.QUERIES[name](spark, SF).collect()
        assert sorted((r["user_id"], r["start"], r["end"]) for r in found) == want
    sampled = [(r["user_id"], r["start"], r["end"]) for r in catalog.QUERIES["sample_augmented"](spark, SF).collect()]
    assert len(set(sampled)) == len(sampled) == 20 * len(n) and set(sampled) <= set(want)
    assert any(b <= n[u] - 12 for u, _, b in sampled)
    drawn = [(r["user_id"], r["start"], r["end"]) for r in catalog.QUERIES["sample_augmented_whole"](spark, SF).collect()]
    assert 500 < len(set(drawn)) == len(drawn) <= 512 and set(drawn) <= set(want)
