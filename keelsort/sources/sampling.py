"""Samples of files: windows of consecutive rows, exact-size key samples."""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelsort.functions.ordering import POSITION, col, with_position
from keelsort.sources.storage import FileInfo, footers, inventory, spread_indices

METHODS = ("row_groups", "head")


def window_of(group_rows: Sequence[int], rows: int, seed: str, method: str = "row_groups") -> tuple[int, int]:
    """(start, length) of a window: from a row group drawn by its rows, moved back where the file ends too soon."""
    if method not in METHODS:
        raise ValueError(f"sample_method must be one of {METHODS}")
    total = sum(group_rows)
    length = min(rows, total)
    if method == "head" or length == total:
        return 0, length
    pick = random.Random(seed).randrange(total)
    start = 0
    for n in group_rows:
        if pick < start + n:
            break
        start += n
    return min(start, total - length), length


def file_window(spark: SparkSession, file: str, start: int, length: int) -> DataFrame:
    """Consecutive rows of a file by their index, with their position."""
    return with_position(spark.read.parquet(file)).where(F.col(POSITION[1]).between(start, start + length - 1))


def sample_files(spark: SparkSession, files: Sequence[FileInfo], sample_rows: int, method: str = "row_groups", seed: int = 0) -> DataFrame:
    """Equal shares of windows over the given files, with positions."""
    if sample_rows <= 0:
        raise ValueError("sample_rows must be positive")
    groups: dict[str, list[int]] = {}
    for r in footers(spark, [f.path for f in files]).where("row_group is not null").select("path", "row_group", "group_rows").distinct().orderBy("path", "row_group").collect():
        groups.setdefault(r["path"], []).append(r["group_rows"])
    each, more = divmod(sample_rows, len(files))
    out = None
    for i, f in enumerate(files):
        start, length = window_of(groups.get(f.path, []), each + (i < more), f"{seed}:{f.relative}", method)
        if length:
            part = file_window(spark, f.path, start, length)
            out = part if out is None else out.unionByName(part)
    return out if out is not None else with_position(spark.read.parquet(files[0].path))


def sample_dataset(spark: SparkSession, source: str, sample_rows: int = 250_000, sample_files_: int = 32, sample_method: str = "row_groups", seed: int = 0) -> DataFrame:
    """Windows from files spread over a tree."""
    files = inventory(spark, source)
    chosen = [files[i] for i in spread_indices(len(files), sample_files_)]
    return sample_files(spark, chosen, sample_rows, sample_method, seed)


def head(df: DataFrame, rows: int, order: Sequence[str] | None = None) -> DataFrame:
    """The first rows in the order of the files, or of unique columns."""
    placed, by = (df, [col(c) for c in order]) if order else (with_position(df), [F.col(c) for c in POSITION])
    return placed.orderBy(*by).limit(rows).select(*[col(c) for c in df.columns])


def key_sample(df: DataFrame, keys: Sequence[str], identity: Sequence[str], rows: int, seed: int = 0) -> DataFrame:
    """Exactly ``rows`` rows (all, if fewer) of keys and identity by the smallest seeded hash of the identity."""
    narrow = df.select(*[col(c) for c in dict.fromkeys([*keys, *identity])])
    return narrow.orderBy(F.xxhash64(F.lit(seed), *[col(c) for c in identity]), *[col(c) for c in identity]).limit(rows)
