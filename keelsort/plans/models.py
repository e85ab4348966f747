"""Profiles and plans: frozen values on the driver, with JSON forms."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import types as T

FORMAT_VERSION = 1


@dataclass(frozen=True)
class ColumnProfile:
    """Measurements of one column; counts are exact for the planning sample, bytes and nulls for the whole table."""

    name: str
    data_type: str
    byte_size: int
    order_sensitive_bytes: int
    null_count: int
    sampled_rows: int
    sample_distinct: int
    sample_runs: int
    dominant_fraction: float
    gini_impurity: float
    repeatability: float
    cluster_gain: float
    potential_bytes: float
    eligible: bool
    reason: str | None = None

    @property
    def effective_cardinality(self) -> float:
        """Inverse of the chance that two rows agree, within 1/n and the distinct count."""
        if not self.sampled_rows or not self.sample_distinct:
            return 0.0
        alike = max(1.0 / self.sampled_rows, 1.0 - self.gini_impurity)
        return min(float(self.sample_distinct), 1.0 / alike)

    def as_dict(self) -> dict[str, Any]:
        return asdict(self)


@dataclass(frozen=True)
class SortPlan:
    """How a table of ``total_rows`` rows is to be sorted."""

    requested_algorithm: str
    algorithm: str
    sort_keys: tuple[str, ...]
    prefix_keys: tuple[str, ...] = ()
    profiles: tuple[ColumnProfile, ...] = ()
    total_rows: int = 0
    sampled_rows: int = 0
    value_order: str = "natural"
    null_placement: str = "at_end"
    trial_evaluations: int = 0
    baseline_score: float | None = None
    estimated_score: float | None = None
    score_kind: str | None = None
    note: str | None = None

    @property
    def sorting_keys(self) -> tuple[str, ...]:
        """Keys in natural order, which alone may be advertised to readers."""
        return self.prefix_keys if self.value_order == "frequency" else self.sort_keys

    @property
    def sort_order(self) -> list[tuple[str, str]]:
        return [(k, "ascending") for k in self.sorting_keys]

    def profile(self, name: str) -> ColumnProfile:
        return {p.name: p for p in self.profiles}[name]

    def as_dict(self, include_profiles: bool = True) -> dict[str, Any]:
        out = asdict(self)
        out["sort_keys"], out["prefix_keys"] = list(self.sort_keys), list(self.prefix_keys)
        if include_profiles:
            out["profiles"] = [p.as_dict() for p in self.profiles]
        else:
            del out["profiles"]
        return out

    def explain(self) -> str:
        lines = [f"algorithm: {self.algorithm}", f"sample: {self.sampled_rows:,} of {self.total_rows:,} rows", "sort keys: " + (", ".join(self.sort_keys) or "(input order)")]
        if self.value_order != "natural":
            lines.append(f"value order: {self.value_order}")
        if self.trial_evaluations:
            lines.append(f"trials: {self.trial_evaluations:,}")
        if self.score_kind and self.baseline_score and self.estimated_score is not None:
            lines.append(f"{self.score_kind}: {self.baseline_score:,.0f} -> {self.estimated_score:,.0f} ({1 - self.estimated_score / self.baseline_score:.2%} less)")
        if self.note:
            lines.append(f"note: {self.note}")
        return "\n".join(lines)


def _plain(kind: T.DataType) -> str:
    """A type's text without names of list elements, which carry no meaning."""
    return kind.simpleString()


@dataclass(frozen=True)
class RewritePlan:
    """A learnt order, independent of the number of rows, to be applied to files of one schema."""

    sort_keys: tuple[str, ...]
    prefix_keys: tuple[str, ...] = ()
    algorithm: str = "none"
    value_order: str = "natural"
    null_placement: str = "at_end"
    columns: tuple[tuple[str, str, bool], ...] = ()
    compression: str | dict | None = None
    compression_level: int | dict | None = None
    row_group_size: int | None = None
    validation: tuple[dict, ...] = ()
    details: dict = field(default_factory=dict)

    @staticmethod
    def learnt(plan: SortPlan, schema: T.StructType, **settings: Any) -> RewritePlan:
        return RewritePlan(
            plan.sort_keys, plan.prefix_keys, plan.algorithm, plan.value_order, plan.null_placement, tuple((f.name, _plain(f.dataType), f.nullable) for f in schema.fields), **settings
        )

    def bind(self, schema: T.StructType, rows: int) -> SortPlan:
        """The plan for one table; ValueError where its schema does not fit. New columns are tolerated."""
        if len(set(schema.names)) != len(schema.names):
            raise ValueError("table repeats a column name")
        for name, kind, nullable in self.columns:
            if name not in schema.names:
                raise ValueError(f"column {name!r} of the plan is not in the table")
            if _plain(schema[name].dataType) != kind:
                raise ValueError(f"column {name!r} is {_plain(schema[name].dataType)}, the plan has {kind}")
            if schema[name].nullable != nullable:
                raise ValueError(f"column {name!r} differs from the plan in whether it may be null")
        missing = [k for k in self.sort_keys if k not in schema.names]
        if missing:
            raise ValueError(f"sort keys not in table: {missing}")
        return SortPlan(self.algorithm, self.algorithm, self.sort_keys, self.prefix_keys, total_rows=rows, value_order=self.value_order, null_placement=self.null_placement)

    def to_json(self) -> str:
        out = {"format_version": FORMAT_VERSION} | {f.name: getattr(self, f.name) for f in fields(self)}
        return json.dumps(out, indent=1, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> RewritePlan:
        try:
            raw = json.loads(text)
        except ValueError as problem:
            raise ValueError("not a plan: no JSON") from problem
        if not isinstance(raw, dict) or raw.get("format_version") != FORMAT_VERSION:
            raise ValueError(f"not a plan of format version {FORMAT_VERSION}")
        del raw["format_version"]
        known = {f.name for f in fields(RewritePlan)}
        if set(raw) - known or "sort_keys" not in raw:
            raise ValueError(f"not a plan: unknown or missing fields {sorted(set(raw) - known)}")
        for name in ("sort_keys", "prefix_keys"):
            if not all(isinstance(k, str) for k in raw.get(name, [])):
                raise ValueError(f"{name} must be column names")
            raw[name] = tuple(raw.get(name, ()))
        if raw.get("value_order", "natural") not in ("natural", "frequency"):
            raise ValueError("value_order must be natural or frequency")
        if raw.get("null_placement", "at_end") not in ("at_end", "at_start"):
            raise ValueError("null_placement must be 'at_start' or 'at_end'")
        if tuple(raw["sort_keys"][: len(raw["prefix_keys"])]) != raw["prefix_keys"]:
            raise ValueError("sort_keys must begin with prefix_keys")
        raw["columns"] = tuple(tuple(c) for c in raw.get("columns", ()))
        raw["validation"] = tuple(raw.get("validation", ()))
        return RewritePlan(**raw)

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            f.write(self.to_json() + "\n")

    @staticmethod
    def load(path: str) -> RewritePlan:
        with open(path, encoding="utf-8") as f:
            return RewritePlan.from_json(f.read())


@dataclass(frozen=True)
class WriteResult:
    """What was done to one file."""

    source: str
    destination: str
    action: str  # written, kept (not smaller), copied, skipped, resumed
    rows: int = 0
    source_bytes: int = 0
    output_bytes: int = 0
    seconds: float = 0.0
    plan: SortPlan | None = None


@dataclass(frozen=True)
class DatasetRewriteResult:
    results: tuple[WriteResult, ...]

    def count(self, action: str) -> int:
        return sum(r.action == action for r in self.results)

    @property
    def source_bytes(self) -> int:
        return sum(r.source_bytes for r in self.results)

    @property
    def output_bytes(self) -> int:
        return sum(r.output_bytes for r in self.results)


@dataclass(frozen=True)
class BenchmarkResult:
    algorithm: str
    sort_keys: tuple[str, ...]
    output_bytes: int
    baseline_bytes: int
    planning_seconds: float
    total_seconds: float

    @property
    def savings(self) -> float:
        return 1 - self.output_bytes / self.baseline_bytes if self.baseline_bytes else 0.0


@dataclass(frozen=True)
class OptimizationResult:
    table: Any
    plan: SortPlan
    planning_seconds: float
    apply_seconds: float
