"""Row order and Parquet layout on Spark: profile, plan, sort, write, verify."""

from keelsort.operators.learning import benchmark, fit, fit_dataset, validate_plan
from keelsort.operators.planning import apply_plan, optimize, plan_sort
from keelsort.operators.profile import profile_table
from keelsort.operators.rewrite import rewrite, rewrite_dataset, rewrite_file
from keelsort.plans.models import BenchmarkResult, ColumnProfile, DatasetRewriteResult, OptimizationResult, RewritePlan, SortPlan, WriteResult
from keelsort.plans.planners import ALGORITHMS
from keelsort.sources.sampling import sample_dataset
from keelsort.sources.storage import read_parquet
from keelsort.sources.writer import write

__all__ = [
    "ALGORITHMS", "BenchmarkResult", "ColumnProfile", "DatasetRewriteResult", "OptimizationResult", "RewritePlan", "SortPlan", "WriteResult", "apply_plan", "benchmark", "fit", "fit_dataset",
    "optimize", "plan_sort", "profile_table", "read_parquet", "rewrite", "rewrite_dataset", "rewrite_file", "sample_dataset", "validate_plan", "write",
]
