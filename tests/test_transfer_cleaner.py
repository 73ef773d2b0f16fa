"""A transferred cleaner is the source's only if all of its parameters are."""

import datetime

import duckdb
import pytest

from noveltybench.operators import clean
from noveltybench.plans import registry

SCHEMA = "place int, feature string, median double, log1p boolean, mean double, std double, dropped string"
FIRST = (0, "x", 2.0, True, 3.0, 1.5, None)
SECOND = (1, "y", 1.0, False, 1.0, 0.0, "zero variance")
LINE = "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"


def differing(spark, a, b):
    found = clean.differing(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA))
    return sorted(r["feature"] for r in found.collect())


def changed(**values):
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    return tuple(values.get(n, v) for n, v in zip(names, FIRST))


@pytest.mark.parametrize("change", [{"place": 2}, {"median": 2.5}, {"log1p": False}, {"mean": 3.1}, {"mean": 3.00000001}, {"std": 1.6}, {"dropped": "zero variance"}, {"mean": None}, {"std": float("nan")}, {"mean": float("inf")}])
def test_any_parameter_counts(spark, change):
    assert differing(spark, [FIRST, SECOND], [changed(**change), SECOND]) == ["x"]
    assert differing(spark, [changed(**change), SECOND], [FIRST, SECOND]) == ["x"]


def test_the_order_of_sums_does_not_count(spark):
    assert differing(spark, [FIRST, SECOND], [changed(mean=3.0 + 4e-15, std=1.5 - 2e-15), SECOND]) == []
    assert differing(spark, [changed(mean=1e-17, std=1.0)], [changed(mean=-1e-17, std=1.0)]) == []
    odd = changed(mean=float("inf"), std=float("nan"))
    assert differing(spark, [odd, SECOND], [odd, SECOND]) == []


def test_features_of_one_side_count(spark):
    assert differing(spark, [FIRST], [FIRST, SECOND]) == ["y"]
    assert differing(spark, [FIRST, SECOND], [SECOND]) == ["x"]


def violations(spark, tmp_path, lines):
    rows = [(key, 1, i, quantity, 100.0, 0.1, 0.1, "N", side, datetime.datetime(2024, 1, 1)) for i, (key, side, quantity) in enumerate(lines)]
    spark.createDataFrame(rows, LINE).repartition(3).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = registry.queries()["verify_transfer_cleaner"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert [tuple(r) for r in got] == con.sql(registry.oracle_sql()["verify_transfer_cleaner"]).fetchall()
    return got[0]["violations"]


def test_equal_medians_are_not_enough(spark, tmp_path):
    """Train rows (even keys) and the other rows share the medians; quantity and its copy differ in mean and deviation."""
    lines = [(2, "F", q) for q in (1.0, 2.0, 3.0)] + [(1, "O", q) for q in (1.0, 2.0, 30.0)]
    assert violations(spark, tmp_path, lines) == 2


def test_equal_means_are_not_enough(spark, tmp_path):
    lines = [(2, "F", q) for q in (1.0, 2.0, 3.0)] + [(1, "O", q) for q in (0.5, 2.0, 3.5)]
    assert violations(spark, tmp_path, lines) == 2


def test_a_fit_on_the_same_rows_passes(spark, tmp_path):
    lines = [(2, "O", 0.1 * q) for q in range(1, 200)] + [(1, "F", 7.0)]
    assert violations(spark, tmp_path, lines) == 0


def test_no_other_rows(spark, tmp_path):
    assert violations(spark, tmp_path, [(2, "F", 1.0), (4, "F", 2.0)]) == 6
