"""Keys that the small tables do not have."""

from sparkloom.plans.registry import QUERIES


def test_every_customer_is_shown(spark, tmp_path):
    keys = [1, 999, 1000, 9999, 10_000, 15_000, 99_999, 100_000, 9_999_999, 10_000_000, 2**62]
    spark.createDataFrame([(k, 1.25) for k in keys], "c_custkey bigint, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    out = {r.c_custkey: (r.digits, r.shown) for r in QUERIES["rc27_rounding_and_pictures"](spark, str(tmp_path)).collect()}
    assert out == {k: (f"{k:07d}", f"{k:>6,}") for k in keys}
