"""Learn one plan for many files: `fit`, `fit_dataset`, validation, and same-writer comparisons."""

from __future__ import annotations

import time
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession

from keelsort.operators.planning import plan_sort
from keelsort.plans.models import BenchmarkResult, RewritePlan, SortPlan
from keelsort.plans.planners import normalized
from keelsort.session import shared_dir
from keelsort.sources import sampling, storage
from keelsort.sources.writer import write_sorted

#: Algorithms that are compared unless others are named; the searches over all and over runs are left out.
COMPARED = ("none", "cardinality", "weighted", "entropy", "payload", "frequency", "portfolio", "codec_fast", "codec", "auto")


def written_bytes(df: DataFrame, plan: SortPlan, order: Sequence[str] | None = None, **settings) -> int:
    """Bytes of ``df`` in the plan's order under one writer's settings; the file goes again."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    try:
        return sum(storage.size_of(spark, p) for p in write_sorted(df, plan, f"{folder}/trial.parquet", order=order, **settings))
    finally:
        storage.delete(spark, folder)


def fit(
    df: DataFrame, algorithms: Sequence[str] = ("codec_fast", "portfolio"), prefix: Sequence[str] = (), compression="zstd", compression_level=None, row_group_size: int | None = None,
    min_improvement: float = 0.005, order: Sequence[str] | None = None, writer: str = "spark", **planning,
) -> RewritePlan:
    """The algorithm of the smallest file, the earliest of equals, where it beats the prefix order by ``min_improvement``."""
    if not 0 <= min_improvement < 1:
        raise ValueError("min_improvement must be in [0, 1)")
    names = list(dict.fromkeys(normalized(a) for a in algorithms))
    level = None if isinstance(compression, dict) else storage.effective_level(compression, compression_level)
    settings = {"compression": compression, "compression_level": compression_level if isinstance(compression, dict) else level, "row_group_size": row_group_size, "writer": writer}
    base = plan_sort(df, "none", prefix, order=order, **{k: v for k, v in planning.items() if k == "null_placement"})
    smallest = baseline = written_bytes(df, base, order, **settings)
    best, sizes = base, {"none": baseline}
    for name in names:
        if name == "none":
            continue
        plan = plan_sort(df, name, prefix, order=order, **planning)
        size = baseline if plan.sort_keys == base.sort_keys else written_bytes(df, plan, order, **settings)
        sizes[name] = size
        if size < smallest:
            smallest, best = size, plan
    if baseline and (baseline - smallest) / baseline < min_improvement:
        best = base
    return RewritePlan.learnt(best, df.schema, compression=compression, compression_level=settings["compression_level"], row_group_size=row_group_size, details={"bytes": sizes})


def validate_plan(df: DataFrame, plan: RewritePlan, order: Sequence[str] | None = None, writer: str = "spark", label: str = "") -> dict:
    """Bytes with the prefix order and with the plan, and the share saved."""
    bound = plan.bind(df.schema, df.count())
    base = replace(bound, sort_keys=bound.prefix_keys, value_order="natural")
    settings = {"compression": plan.compression or "zstd", "compression_level": plan.compression_level, "row_group_size": plan.row_group_size, "writer": writer}
    before = written_bytes(df, base, order, **settings)
    after = before if bound.sort_keys == base.sort_keys and bound.value_order == "natural" else written_bytes(df, bound, order, **settings)
    return {"file": label, "rows": bound.total_rows, "baseline_bytes": before, "plan_bytes": after, "savings": 1 - after / before if before else 0.0}


def fit_dataset(
    spark: SparkSession, source: str, sample_rows: int = 250_000, sample_files: int = 32, sample_method: str = "row_groups", seed: int = 0, footer_files: int = 256, validation_files: int = 4,
    validation_rows: int = 100_000, compression="preserve", compression_level="preserve", compression_manifest: dict | None = None, writer: str = "spark", **options,
) -> RewritePlan:
    """Learn a plan from windows of spread files and check it on files that were not learnt from."""
    files = storage.inventory(spark, source)
    train = [files[i] for i in storage.spread_indices(len(files), sample_files)]
    rest = [f for f in files if f not in train]
    held = [rest[i] for i in storage.spread_indices(len(rest), validation_files)] if rest and validation_files else []
    # no number of footers means all of them
    looked = [files[i] for i in storage.spread_indices(len(files), footer_files or len(files))]
    found = storage.footers(spark, [f.path for f in dict.fromkeys([*looked, *train, *held])])
    storage.check_one_schema(found)
    codec, level = storage.resolve_compression(storage.inspect_compression(found, compression_manifest), compression, compression_level)
    if isinstance(codec, dict):
        writer = "arrow"
    sample = sampling.sample_files(spark, train, sample_rows, sample_method, seed)
    from keelsort.functions.ordering import POSITION

    # the sample is written once: its rows then have positions of their own
    folder = shared_dir(spark)
    try:
        sample.coalesce(1).sortWithinPartitions(*POSITION).drop(*POSITION).write.parquet(folder)
        table = spark.read.parquet(folder)
        plan = fit(table, compression=codec, compression_level=level, writer=writer, **options)
        checks = []
        for f in held:
            part = f"{folder}-{len(checks)}"
            sampling.sample_files(spark, [f], validation_rows, sample_method, seed).coalesce(1).sortWithinPartitions(*POSITION).drop(*POSITION).write.parquet(part)
            try:
                checks.append(validate_plan(spark.read.parquet(part), plan, writer=writer, label=f.relative))
            finally:
                storage.delete(spark, part)
    finally:
        storage.delete(spark, folder)
    return replace(plan, validation=tuple(checks))


def benchmark(
    df: DataFrame, algorithms: Sequence[str] = COMPARED, compression="zstd", compression_level=None, row_group_size: int | None = None, order: Sequence[str] | None = None, writer: str = "spark",
    parallel: int = 1, **planning,
) -> list[BenchmarkResult]:
    """Bytes of each algorithm under the same writer; the baseline is `none`, else the first."""
    names = list(dict.fromkeys(normalized(a) for a in algorithms))
    if not names:
        raise ValueError("name at least one algorithm")

    def one(name: str):
        began = time.perf_counter()
        plan = plan_sort(df, name, order=order, **planning)
        planned = time.perf_counter()
        size = written_bytes(df, plan, order, compression=compression, compression_level=compression_level, row_group_size=row_group_size, writer=writer)
        return name, plan.sort_keys, size, planned - began, time.perf_counter() - began

    with ThreadPoolExecutor(max(1, parallel)) as pool:
        got = list(pool.map(one, names))
    base = next((g for g in got if g[0] == "none"), got[0])[2]
    return [BenchmarkResult(name, keys, size, base, planning_s, total) for name, keys, size, planning_s, total in got]


def benchmark_frame(spark: SparkSession, results: Sequence[BenchmarkResult]) -> DataFrame:
    rows = [(r.algorithm, ",".join(r.sort_keys), r.output_bytes, r.baseline_bytes, r.savings, r.planning_seconds, r.total_seconds) for r in results]
    return spark.createDataFrame(rows, "algorithm string, sort_keys string, output_bytes long, baseline_bytes long, savings double, planning_seconds double, total_seconds double")


def savings_summary(results: Sequence[dict]) -> dict[str, float]:
    """Smallest, mean and largest share saved, and totals."""
    if not results:
        return {"files": 0}
    shares = [r["savings"] for r in results]
    return {
        "files": len(shares), "least": min(shares), "mean": sum(shares) / len(shares), "most": max(shares),
        "baseline_bytes": sum(r["baseline_bytes"] for r in results), "plan_bytes": sum(r["plan_bytes"] for r in results),
    }
