import pytest
from pyspark.sql import functions as F

from keelsort.operators.planning import apply_plan, optimize, permutation, plan_sort
from keelsort.plans import planners
from keelsort.plans.models import ColumnProfile, RewritePlan, SortPlan
from keelsort.plans.planners import Trials


def of(name, ndv=4, potential=100.0, gini=0.5, dominant=0.5, size=100, rows=100):
    return ColumnProfile(name, "bigint", size, size, 0, rows, ndv, rows, dominant, gini, 1 - ndv / rows, 0.9, potential, True)


def test_rules():
    found = [of("low", 2, 10), of("high", 50, 1000), of("mid", 5, 100)]
    assert planners.ruled("cardinality", found, 2) == ["low", "mid"]
    assert planners.ruled("weighted", found, 2) == ["mid", "high"]
    skewed, uniform = of("skewed", 4, 50, gini=0.06), of("uniform", 2, 50, gini=0.5)
    assert planners.ruled("entropy", [uniform, skewed], 2) == ["skewed", "uniform"]


def test_candidates_leave_out_the_hopeless():
    found = [of("a"), of("constant", 1), of("nearly", dominant=0.99999), of("unique", 100), of("sorted", potential=0.0)]
    assert [p.name for p in planners.candidates(found)] == ["a"]
    assert planners.candidates(found, include=set()) == [] and planners.candidates(found, prefix=["a"]) == []


def trials_of(costs):
    seen = []

    def measure(wanted):
        seen.extend(wanted)
        return {w: costs[w[0]] for w in wanted if w[0] in costs}

    return Trials(measure), seen


def test_greedy_takes_the_best_and_breaks_ties_by_name():
    trials, _ = trials_of({(): 100, ("a",): 80, ("b",): 80, ("a", "b"): 79.9})
    got = planners.greedy(trials, ["b", "a"], (), 8, 0.005)
    assert got.keys == ("a",) and got.baseline == 100 and got.cost == 80 and got.evaluations == 4


def test_greedy_budget_counts_failures_and_the_baseline():
    trials, seen = trials_of({(): 100, ("b",): 50})
    got = planners.greedy(trials, ["a", "b", "c"], (), 8, 0.005, at_once=4, budget=3)
    assert got.keys == ("b",) and got.evaluations == 3 and [w[0] for w in seen] == [(), ("a",), ("b",)]


def test_portfolio_keeps_the_baseline_and_encodes_each_plan_once():
    found = [of("a", 2, 10), of("b", 3, 20)]
    trials, seen = trials_of({(): 100, ("a", "b"): 99.9, ("b", "a"): 99.8})
    got = planners.portfolio(trials, found, (), 8, 12, 0.005)
    assert got.keys == () and len(seen) == len(set(seen))


def table(spark):
    rows = [(i, i % 3, f"label-{i * 7 % 11 % 7}" + "x" * 30, i * 5 % 11, i * 7919 % 600) for i in range(600)]
    return spark.createDataFrame(rows, "id long, small long, label string, code long, other long")


@pytest.mark.parametrize("algorithm", planners.ALGORITHMS)
def test_every_algorithm_gives_a_stable_order(spark, algorithm):
    df = table(spark)
    plan = plan_sort(df, algorithm, prefix=["small"], order=["id"], max_sort_columns=3)
    assert plan.sort_keys[:1] == ("small",) and plan.requested_algorithm == algorithm and len(plan.sort_keys) <= 3
    rows = apply_plan(df, plan, order=["id"]).collect()
    assert sorted(r["id"] for r in rows) == list(range(600))
    if plan.value_order == "natural":
        keys = [tuple(r[k] for k in plan.sort_keys) + (r["id"],) for r in rows]
        assert keys == sorted(keys)
    plan.explain()


@pytest.mark.parametrize(
    "options",
    [
        {"algorithm": "best"}, {"prefix": ["nope"]}, {"prefix": ["id", "id"]}, {"include": ["nope"]}, {"exclude": ["nope"]}, {"prefix": ["id"], "exclude": ["id"]}, {"max_sort_columns": -1},
        {"candidate_pool_size": 0}, {"min_run_improvement": 1}, {"min_trial_improvement": -0.1}, {"trial_sample_rows": 0}, {"run_sample_rows": 0}, {"fast_candidate_count": 0},
        {"max_trial_evaluations": 0}, {"sort_backend": "gpu"}, {"null_placement": "middle"},
    ],
)
def test_options_are_checked(spark, options):
    with pytest.raises(ValueError):
        plan_sort(table(spark), order=["id"], **options)


def test_plans_are_for_their_rows(spark):
    df = table(spark)
    plan = plan_sort(df, "entropy", order=["id"])
    with pytest.raises(ValueError):
        apply_plan(df.limit(5), plan, order=["id"])
    assert sorted(r["new_row"] for r in permutation(df, plan, ["id"]).collect()) == list(range(600))
    assert optimize(df, "payload", order=["id"]).table.count() == 600


def test_plan_json(tmp_path, spark):
    df = table(spark)
    plan = RewritePlan.learnt(SortPlan("entropy", "entropy", ("small", "code"), ("small",)), df.schema, compression="zstd", compression_level=3)
    plan.save(str(tmp_path / "plan.json"))
    assert RewritePlan.load(str(tmp_path / "plan.json")) == plan
    assert plan.bind(df.withColumn("new", F.lit(1)).schema, 7).total_rows == 7
    for wrong in (df.drop("code"), df.withColumn("code", F.col("code").cast("int")), df.withColumn("code", F.lit(1).cast("long"))):
        with pytest.raises(ValueError):
            plan.bind(wrong.schema, 1)
    for text in ("{", "[]", '{"format_version": 2}', plan.to_json().replace("at_end", "middle"), plan.to_json().replace('"prefix_keys": [\n  "small"', '"prefix_keys": [\n  "code"')):
        with pytest.raises(ValueError):
            RewritePlan.from_json(text)


def test_frequency_advertises_the_prefix_only():
    plan = SortPlan("frequency", "frequency", ("a", "b"), ("a",), value_order="frequency")
    assert plan.sorting_keys == ("a",) and plan.sort_order == [("a", "ascending")]
