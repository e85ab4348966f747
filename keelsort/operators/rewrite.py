"""Rewrite files and trees by a saved plan: preflight, size guard, checkpoints, shards."""

from __future__ import annotations

import hashlib
import json
import os
import time
from collections.abc import Callable
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from dataclasses import asdict

from pyspark.sql import SparkSession

from keelsort.plans.models import DatasetRewriteResult, RewritePlan, WriteResult
from keelsort.sources import storage
from keelsort.sources.storage import FileInfo
from keelsort.sources.writer import write_sorted

STATE = "_keelsort_state"


def _needs_arrow(compression) -> bool:
    return isinstance(compression, dict)


def _exact_types(text: str) -> list[str]:
    """Columns whose physical type Spark's writer would not keep."""
    lost = ("uint", "fixed_size_binary", "duration", "time64", "time32", "halffloat", "decimal256", "null", "timestamp[ns")
    out = []
    for part in text.split(";"):
        name, _, kind = part.partition(":")
        if any(k in kind.rpartition(":")[0] for k in lost):
            out.append(name)
    return out


def rewrite_file(
    spark: SparkSession, source: str, destination: str, plan: RewritePlan, compression="preserve", compression_level="preserve", compression_manifest: dict | None = None, skip_unchanged: bool = True,
    overwrite: bool = False, writer: str = "spark", row_group_size: int | None = None, **options,
) -> WriteResult:
    """Apply a plan to one file.

    Where the plan has no required prefix, all settings are the source's and
    ``skip_unchanged`` holds, the result is published only if it is smaller than the
    source; else the source's bytes are. What the caller asks for is always written.
    A plan without keys and with the source's settings copies the bytes, or leaves the
    file alone where source and destination are one.
    """
    began = time.perf_counter()
    info = storage.inventory(spark, source)
    if len(info) != 1:
        raise ValueError(f"{source} is not one file")
    target = destination
    in_place = _same(spark, source, target)
    if storage.exists(spark, target) and not (overwrite or in_place):
        raise FileExistsError(target)
    found = storage.footers(spark, [info[0].path]).cache()
    try:
        codec, level = storage.resolve_compression(storage.inspect_compression(found, compression_manifest), compression, compression_level)
        preserved = skip_unchanged and compression == "preserve" and compression_level == "preserve" and row_group_size is None and not options
        first = found.select("rows", "arrow_schema").first()
    finally:
        found.unpersist()
    df = spark.read.parquet(info[0].path)
    bound = plan.bind(df.schema, first["rows"])

    def done(action: str, size: int) -> WriteResult:
        return WriteResult(source, target, action, first["rows"], info[0].size, size, time.perf_counter() - began, bound)

    if preserved and not plan.sort_keys:
        if in_place:
            return done("skipped", info[0].size)
        storage.copy(spark, info[0].path, target, overwrite)
        return done("copied", info[0].size)
    lost = _exact_types(first["arrow_schema"])
    if lost:
        raise ValueError(f"columns {lost} have types that a rewrite would change")
    if _needs_arrow(codec):
        writer = "arrow"
    folder, _, name = target.rpartition("/")
    candidate = f"{folder}/.{name}.keelsort-{os.urandom(16).hex()}.tmp/{name}"
    try:
        made = write_sorted(df, bound, candidate, codec, level, row_group_size or plan.row_group_size, writer=writer, **options)
        size = storage.size_of(spark, made[0])
        if size < info[0].size or not preserved or plan.prefix_keys:
            storage.rename(spark, made[0], target, overwrite or in_place)
            return done("written", size)
    finally:
        storage.delete(spark, candidate.rpartition("/")[0])
    if not in_place:
        storage.copy(spark, info[0].path, target, overwrite)
    return done("kept", info[0].size)


def _same(spark: SparkSession, a: str, b: str) -> bool:
    fs, x = storage._path(spark, a)
    fs2, y = storage._path(spark, b)
    return fs.makeQualified(x).toString() == fs2.makeQualified(y).toString()


def run_fingerprint(plan: RewritePlan, compression, level, manifest, row_group_size, options: dict) -> str:
    """Of all settings that decide the output's bytes."""
    parts = {"keys": plan.sort_keys, "prefix": plan.prefix_keys, "order": plan.value_order, "nulls": plan.null_placement, "compression": compression, "level": level, "manifest": manifest, "rows": row_group_size or plan.row_group_size, "options": options}
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


def _marker(spark: SparkSession, destination: str, relative: str) -> str:
    return f"{destination.rstrip('/')}/{STATE}/{hashlib.sha256(relative.encode()).hexdigest()[:40]}.json"


def _put(spark: SparkSession, path: str, text: str) -> None:
    """A small file, whole or not at all."""
    fs, target = storage._path(spark, path)
    _, hidden = storage._path(spark, f"{path}.tmp")
    fs.mkdirs(target.getParent())
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    storage.rename(spark, f"{path}.tmp", path, overwrite=True)


def _markers(spark: SparkSession, destination: str) -> dict[str, dict]:
    folder = f"{destination.rstrip('/')}/{STATE}"
    if not storage.exists(spark, folder):
        return {}
    rows = spark.read.option("wholetext", True).text(folder).collect()
    out = {}
    for r in rows:
        try:
            x = json.loads(r[0])
            out[x["relative"]] = x
        except (ValueError, KeyError):
            continue
    return out


def rewrite_dataset(
    spark: SparkSession, source: str, destination: str, plan: RewritePlan, workers: int = 1, shard: str | tuple[int, int] | None = None, checkpoint: bool = True,
    progress: Callable[[WriteResult], None] | None = None, overwrite: bool = False, compression="preserve", compression_level="preserve", compression_manifest: dict | None = None,
    row_group_size: int | None = None, writer: str = "spark", **options,
) -> DatasetRewriteResult:
    """Rewrite every file of a tree under its relative path. Everything is checked before anything is published.

    ``workers`` files are in work at once, the largest first; after an error no new one
    starts. Files of finished runs with the same settings are taken from their markers.
    """
    if workers < 1:
        raise ValueError("workers must be positive")
    files = storage.inventory(spark, source)
    if not storage.is_directory(spark, source):
        raise ValueError("the source is not a tree")
    if storage.exists(spark, destination) and not storage.is_directory(spark, destination):
        raise ValueError("the destination is a file")
    in_place = _same(spark, source, destination)
    a, b = _qualified(spark, source), _qualified(spark, destination)
    if not in_place and (b + "/").startswith(a + "/"):
        raise ValueError("the destination lies within the source")
    if shard is not None:
        i, n = storage.parse_shard(shard)
        files = [f for f in files if storage.shard_of(f.relative, n) == i]
    mark = run_fingerprint(plan, compression, compression_level, compression_manifest, row_group_size, options)
    known = _markers(spark, destination) if checkpoint else {}
    resumed: dict[str, WriteResult] = {}
    for f in files:
        m = known.get(f.relative)
        out = f"{b}/{f.relative}"
        if m and m["fingerprint"] == mark and (in_place or (m["size"], m["modified"]) == (f.size, f.modified)) and storage.exists(spark, out) and storage.size_of(spark, out) == m["result"]["output_bytes"]:
            r = m["result"]
            resumed[f.relative] = WriteResult(r["source"], r["destination"], "resumed", r["rows"], r["source_bytes"], r["output_bytes"])
    left = [f for f in files if f.relative not in resumed]
    if left:
        found = storage.footers(spark, [f.path for f in left]).cache()
        try:
            storage.check_one_schema(found)
            manifest = compression_manifest or {}
            default = {k: v for k, v in manifest.items() if k != "files"} or None
            if manifest.get("files"):
                for f in left:
                    own = manifest["files"].get(f.relative, default)
                    storage.resolve_compression(storage.inspect_compression(found.where(found.path == f.path), own), compression, compression_level)
            else:
                storage.resolve_compression(storage.inspect_compression(found, default), compression, compression_level)
            one = found.select("arrow_schema").first()[0]
        finally:
            found.unpersist()
        plan.bind(spark.read.parquet(left[0].path).schema, 0)
        if (plan.sort_keys or compression != "preserve") and _exact_types(one):
            raise ValueError(f"columns {_exact_types(one)} have types that a rewrite would change")
        if not (overwrite or in_place):
            taken = [f.relative for f in left if storage.exists(spark, f"{b}/{f.relative}")]
            if taken:
                raise FileExistsError(f"{len(taken)} outputs exist, the first is {taken[0]}")
        wanted: dict[str, set[str]] = {}
        for f in left:
            folder, _, name = f"{b}/{f.relative}".rpartition("/")
            wanted.setdefault(folder, set()).add(name)
        for folder, names in sorted(wanted.items()):
            for path in storage.stale_temporaries(spark, folder, names):
                storage.delete(spark, path)
        twice = sorted({f.path for f in left} & {f"{b}/{g.relative}" for g in left}) if not in_place else []
        if twice:
            raise ValueError(f"the output would overwrite the source {twice[0]}")

    def one_file(f: FileInfo) -> WriteResult:
        own = (compression_manifest or {}).get("files", {}).get(f.relative) or {k: v for k, v in (compression_manifest or {}).items() if k != "files"} or None
        r = rewrite_file(spark, f.path, f"{b}/{f.relative}", plan, compression, compression_level, own, overwrite=overwrite, writer=writer, row_group_size=row_group_size, **options)
        if checkpoint:
            shown = {k: v for k, v in asdict(r).items() if k != "plan"}
            _put(spark, _marker(spark, b, f.relative), json.dumps({"relative": f.relative, "fingerprint": mark, "size": f.size, "modified": f.modified, "result": shown}))
        if progress:
            progress(r)
        return r

    results = dict(resumed)
    queue = sorted(left, key=lambda f: (-f.size, f.relative))
    with ThreadPoolExecutor(workers) as pool:
        running, failed = {}, None
        while queue or running:
            while queue and len(running) < workers and failed is None:
                f = queue.pop(0)
                running[pool.submit(one_file, f)] = f
            if not running:
                break
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for d in done:
                f = running.pop(d)
                if d.exception() is not None:
                    failed = failed or (f, d.exception())
                else:
                    results[f.relative] = d.result()
        if failed:
            failed[1].add_note(f"while rewriting {failed[0].relative}; files done before stay")
            raise failed[1]
    return DatasetRewriteResult(tuple(results[f.relative] for f in files))


def _qualified(spark: SparkSession, location: str) -> str:
    fs, path = storage._path(spark, location)
    return fs.makeQualified(path).toString().rstrip("/")


def rewrite(spark: SparkSession, source: str, destination: str, plan: RewritePlan | None = None, **options):
    """A file to a file, a tree to a tree (needs a plan), or a tree without partition folders to one sorted file."""
    tree = storage.is_directory(spark, source)
    one = destination.lower().endswith(".parquet")
    tree_only = {"workers", "shard", "checkpoint", "progress"} & set(options)
    if tree and not one:
        if plan is None:
            raise ValueError("a tree is rewritten by a learnt plan")
        return rewrite_dataset(spark, source, destination, plan, **options)
    if tree_only:
        raise ValueError(f"{sorted(tree_only)} are for trees")
    if not tree and plan is not None:
        return rewrite_file(spark, source, destination if one else f"{destination.rstrip('/')}/{source.rstrip('/').rpartition('/')[2]}", plan, **options)
    files = storage.inventory(spark, source)
    if any("=" in part for f in files for part in f.relative.split("/")[:-1]) and tree:
        raise ValueError("values of partition folders would be lost in one file")
    from keelsort.sources.writer import write

    df = storage.read_parquet(spark, source)
    bound = plan.bind(df.schema, df.count()) if plan else None
    return write(df, destination, plan=bound, **options)
