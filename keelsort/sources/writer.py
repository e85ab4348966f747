"""Parquet sinks: sorted files that are published by a rename."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelsort.functions.ordering import POSITION, col, with_position
from keelsort.operators.planning import order_of, plan_sort
from keelsort.plans.models import SortPlan, WriteResult
from keelsort.sources import storage

ROW_GROUP_ROWS = 1_048_576
WRITERS = ("spark", "arrow")


def target_of(destination: str) -> str:
    """A file target as it is; of a directory the file part-00000.parquet."""
    return destination if destination.lower().endswith(".parquet") else destination.rstrip("/") + "/part-00000.parquet"


def _hidden(target: str) -> str:
    folder, _, name = target.rpartition("/")
    return f"{folder}/.{name}.keelsort-{uuid.uuid4().hex}.tmp" if folder else f".{name}.keelsort-{uuid.uuid4().hex}.tmp"


def options_of(compression, level, row_group_size: int | None, use_dictionary=True, bloom_columns: Sequence[str] = ()) -> dict[str, str]:
    """Options of Spark's writer for a codec, level and row-group size."""
    if isinstance(compression, dict) or isinstance(level, dict):
        raise ValueError("Spark's writer has one codec for all columns: use writer='arrow'")
    codec = (compression or "none").lower()
    out = {"compression": "uncompressed" if codec == "none" else codec, "parquet.block.row.count.limit": str(row_group_size or ROW_GROUP_ROWS), "parquet.enable.dictionary": str(bool(use_dictionary)).lower()}
    level = storage.effective_level(codec, level)
    if level is not None:
        out[f"parquet.compression.codec.{codec}.level" if codec == "zstd" else "zlib.compress.level"] = str(level)
    for c in bloom_columns:
        out[f"parquet.bloom.filter.enabled#{c}"] = "true"
        out[f"parquet.bloom.filter.fpp#{c}"] = "0.01"
    return out


def _tagged(df: DataFrame, plan: SortPlan, compression, level) -> DataFrame:
    """Plan and compression provenance in the first field's metadata, which Spark's writer keeps in the footer."""
    if not df.columns:
        return df
    first = df.schema.fields[0]
    meta = dict(first.metadata or {}) | {
        storage.PLAN_KEY: json.dumps(plan.as_dict(include_profiles=False), sort_keys=True),
        storage.COMPRESSION_KEY: json.dumps({"codec": compression, "level": storage.effective_level(compression, level)}, sort_keys=True),
    }
    return df.withMetadata(first.name, meta)


def write_sorted(
    df: DataFrame, plan: SortPlan, destination: str, compression="zstd", compression_level=None, row_group_size: int | None = None, use_dictionary=True, writer: str = "spark",
    overwrite: bool = False, files: int = 1, order: Sequence[str] | None = None, bloom_columns: Sequence[str] = (), write_statistics=True, write_page_index: bool = False,
) -> list[str]:
    """Write ``df`` in the plan's order as one file, or as ``files`` files of disjoint ascending ranges; returns their paths.

    Files are made in a hidden folder beside the target and published by renames on the
    driver, so retries and speculative tasks never publish. The sort spills in Spark.
    """
    if writer not in WRITERS:
        raise ValueError(f"writer must be one of {WRITERS}")
    spark = df.sparkSession
    target = target_of(destination) if files == 1 else destination
    if storage.exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    names = df.columns
    placed, position = (df, [col(c) for c in order]) if order else (with_position(df), [F.col(c) for c in POSITION])
    out, by, _ = order_of(placed, plan, position)
    if files > 1:
        dealt = out.repartitionByRange(files, *by).sortWithinPartitions(*by)
    else:
        dealt = out.coalesce(1).sortWithinPartitions(*by)
    dealt = dealt.select(*[col(c) for c in names])
    hidden = _hidden(target.rstrip("/"))
    try:
        if writer == "spark":
            tagged = _tagged(dealt, plan, compression, compression_level)
            tagged.write.mode("errorifexists").options(**options_of(compression, compression_level, row_group_size, use_dictionary, bloom_columns)).parquet(hidden)
        else:
            _write_arrow(dealt, plan, hidden, compression, compression_level, row_group_size, use_dictionary, write_statistics, write_page_index)
        made = sorted(f.path for f in storage.inventory(spark, hidden))
        published = []
        for i, path in enumerate(made):
            to = target if files == 1 else f"{target.rstrip('/')}/part-{i:05d}.parquet"
            storage.rename(spark, path, to, overwrite)
            published.append(to)
        return published
    finally:
        storage.delete(spark, hidden)


def _write_arrow(df: DataFrame, plan: SortPlan, folder: str, compression, level, row_group_size, use_dictionary, write_statistics, write_page_index) -> None:
    """Arrow's writer in the sorting task: per-column codecs, sorting columns and key-value metadata; streams row groups."""
    rows = row_group_size or ROW_GROUP_ROWS
    keys = list(plan.sorting_keys)
    place = plan.null_placement
    meta = {
        storage.PLAN_KEY.encode(): json.dumps(plan.as_dict(include_profiles=False), sort_keys=True).encode(),
        storage.COMPRESSION_KEY.encode(): json.dumps({"codec": compression, "level": storage.effective_level(compression, level)}, sort_keys=True).encode(),
    }
    level = storage.effective_level(compression, level)
    where = folder if "://" in folder else "file://" + folder.removeprefix("file:") if folder.startswith(("/", "file:")) else folder

    def run(batches):
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        context = TaskContext.get()
        fs, root = pafs.FileSystem.from_uri(where)
        fs.create_dir(root, recursive=True)
        # the name has the attempt: a retried task writes a file of its own, and the one that ends reports it
        path = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}.parquet"
        out, batch_schema, held, n, total = None, None, [], 0, 0

        def flush(everything: bool):
            nonlocal held, n
            table = pa.Table.from_batches(held, batch_schema)
            while n >= rows or (everything and n):
                out.write_table(table.slice(0, rows), row_group_size=rows)
                table = table.slice(rows)
                n = table.num_rows
            held = table.to_batches()

        for batch in batches:
            if out is None:
                schema = batch_schema = batch.schema.with_metadata((batch.schema.metadata or {}) | meta)
                sorting = pq.SortingColumn.from_ordering(schema, [(k, "ascending") for k in keys], null_placement=place) if keys else None
                out = pq.ParquetWriter(path, schema, filesystem=fs, compression=compression or "none", compression_level=level, use_dictionary=use_dictionary, write_statistics=write_statistics, write_page_index=write_page_index, sorting_columns=sorting)
            held.append(batch.replace_schema_metadata(out.schema.metadata))
            n += batch.num_rows
            total += batch.num_rows
            if n >= rows:
                flush(False)
        if out is not None:
            flush(True)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([total], pa.int64())], names=["path", "rows"])

    done = {r["path"] for r in df.mapInArrow(run, "path string, rows long").collect()}
    spark = df.sparkSession
    if not done:
        df.limit(0).coalesce(1).write.mode("append").parquet(folder)
        return
    for f in storage.inventory(spark, folder):
        if not any(f.path.endswith(d.rsplit("/", 1)[-1]) for d in done):
            storage.delete(spark, f.path)


def write(
    df: DataFrame, destination: str, algorithm: str = "auto", plan: SortPlan | None = None, compression="zstd", compression_level=None, row_group_size: int | None = None,
    use_dictionary=True, write_statistics=True, write_page_index: bool = False, overwrite: bool = False, writer: str = "spark", files: int = 1, order: Sequence[str] | None = None,
    bloom_columns: Sequence[str] = (), stream_sort: bool = True, **planning,
) -> WriteResult:
    """Plan (unless a plan is given), sort and write; an existing target is an error unless ``overwrite``."""
    if row_group_size is not None and not 0 < row_group_size <= 64 * ROW_GROUP_ROWS:
        raise ValueError("row_group_size is out of range")
    began = time.perf_counter()
    spark = df.sparkSession
    target = target_of(destination) if files == 1 else destination
    if storage.exists(spark, target) and not overwrite:
        raise FileExistsError(target)
    if plan is None:
        if not isinstance(compression, dict):
            planning.setdefault("trial_compression", compression or "none")
            planning.setdefault("trial_compression_level", storage.effective_level(compression, compression_level))
        plan = plan_sort(df, algorithm, order=order, **planning)
    elif planning:
        raise ValueError(f"a plan is given: planning options {sorted(planning)} have no effect")
    elif plan.total_rows != (rows := df.count()):
        raise ValueError(f"the plan is for {plan.total_rows} rows, the table has {rows}")
    made = write_sorted(df, plan, destination, compression, compression_level, row_group_size, use_dictionary, writer, overwrite, files, order, bloom_columns, write_statistics, write_page_index)
    size = sum(storage.size_of(spark, p) for p in made)
    return WriteResult("", target, "written", plan.total_rows, 0, size, time.perf_counter() - began, plan)
