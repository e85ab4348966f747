import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from keelsort.functions.ordering import dense_ranks, frequency_order, frequency_ranks, run_counts, sort_columns
from keelsort.operators.profile import distributions, numbered, profile_table, stratified_sample, stratified_windows


def frame(spark, rows, schema):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"id long, {schema}")


def test_null_counts_as_a_value_and_json_is_no_key(spark):
    rows = [("a", '{"a": 1}', [1]), (None, '{"a": 2}', [2]), ("b", '{"a": 3}', [3]), ("a", "[1]", [4])]
    found = {p.name: p for p in profile_table(frame(spark, rows, "c string, j string, n array<long>"), order=["id"])}
    assert found["c"].sample_distinct == 3 and found["c"].null_count == 1
    assert not found["j"].eligible and "JSON" in found["j"].reason
    assert not found["n"].eligible
    assert found["id"].sample_distinct == 4


def test_runs_treat_null_and_nan_as_equal(spark):
    nan = float("nan")
    values = [1.0, nan, nan, None, None, 2.0, 2.0, nan, -0.0, 0.0]
    df = frame(spark, [(v,) for v in values], "x double")
    for parts in (1, 3, 7):
        got = run_counts(df, ["x"], [F.col("id")], parts).first()
        assert (got["rows"], got["runs"]) == (10, 6)


def test_runs_of_no_rows(spark):
    got = run_counts(frame(spark, [], "x double"), ["x"], [F.col("id")]).first()
    assert (got["rows"], got["runs"]) == (0, 0)
    assert profile_table(frame(spark, [], "x double"), order=["id"])[1].sample_distinct == 0


def test_distributions_match_arrow(spark):
    rng = random.Random(5)
    values = [rng.choice([None, "a", "b", "c", "d"]) for _ in range(300)]
    got = distributions(frame(spark, [(v,) for v in values], "x string"), ["x"]).first()
    counts = pc.value_counts(pa.array(values)).field("counts").to_pylist()
    assert got["ndv"] == len(counts)
    assert got["dominant_fraction"] == max(counts) / 300
    assert math.isclose(got["gini"], 1 - sum(c * c for c in counts) / 300**2)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 5000), st.integers(1, 6000))
def test_windows_hold_the_sample(rows, sample):
    got = stratified_windows(rows, sample)
    assert sum(n for _, n in got) == min(rows, sample)
    assert all(0 <= s and s + n <= rows for s, n in got)
    # ascending; they overlap only where the sample is nearly the table
    assert all(a[0] <= b[0] for a, b in zip(got, got[1:]))
    if 2 * sample < rows:
        assert all(a[0] + a[1] <= b[0] for a, b in zip(got, got[1:]))


def test_sample_holds_a_row_for_each_window(spark):
    df = spark.range(18)
    got = sorted(r["id"] for r in stratified_sample(df, 18, [F.col("id")], 17).collect())
    want = sorted(r for start, n in stratified_windows(18, 17) for r in range(start, start + n))
    assert got == want and len(got) == 17


def test_sample_sizes_are_checked():
    with pytest.raises(ValueError):
        stratified_windows(10, 0)


@pytest.mark.parametrize("placement", ["at_end", "at_start"])
def test_order_of_nan_and_null(spark, placement):
    nan = float("nan")
    values = [nan, 1.0, None, -1.0, nan, 1.0]
    df = frame(spark, [(v,) for v in values], "x double")
    got = [r["id"] for r in df.orderBy(*sort_columns(df.schema, ["x"], placement), "id").collect()]
    want = pc.sort_indices(pa.table({"x": pa.array(values, from_pandas=False), "id": range(6)}), sort_keys=[("x", "ascending"), ("id", "ascending")], null_placement=placement).to_pylist()
    assert got == want


def test_placement_is_checked(spark):
    with pytest.raises(ValueError):
        sort_columns(frame(spark, [], "x long").schema, ["x"], "first")


def test_numbers_are_whole(spark):
    df = spark.range(0, 20000, numPartitions=6).withColumn("k", F.xxhash64("id"))
    rows = numbered(df, [F.col("k")], "at").orderBy("at").collect()
    assert [r["at"] for r in rows] == list(range(20000))
    assert [r["k"] for r in rows] == sorted(r["k"] for r in rows)


def test_frequency_order(spark):
    df = frame(spark, [(v,) for v in "bacabac"], "value string")
    out, by, _ = frequency_order(df, ["value"])
    assert "".join(r["value"] for r in out.orderBy(*by, "id").collect()) == "aaabbcc"
    ranks = {r["value"]: r["rank"] for r in frequency_ranks(df, "value").collect()}
    assert ranks == {"a": 0, "b": 1, "c": 2}
    assert {r["value"]: r["rank"] for r in dense_ranks(df, "value").collect()} == {"a": 0, "b": 1, "c": 2}


@pytest.mark.parametrize("placement,want", [("at_end", ["b", "b", "a", None]), ("at_start", [None, "b", "b", "a"])])
def test_frequency_nulls(spark, placement, want):
    df = frame(spark, [("b",), (None,), ("a",), ("b",)], "value string")
    out, by, _ = frequency_order(df, ["value"], null_placement=placement)
    assert [r["value"] for r in out.orderBy(*by, "id").collect()] == want


def test_frequency_keys_are_checked(spark):
    df = frame(spark, [([1],)], "n array<long>")
    for keys, prefix in ((["n"], []), (["x"], []), (["id"], ["id"])):
        with pytest.raises(ValueError):
            frequency_order(df, keys, prefix)
