"""Files: inventories, footers, schema checks, compression provenance, shards."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

PLAN_KEY, COMPRESSION_KEY = "keelsort.sort_plan", "keelsort.compression"
#: Codecs with levels and the level each library takes by default.
DEFAULT_LEVELS = {"zstd": 1, "gzip": 9, "brotli": 1}
TEMPORARY = re.compile(r"^\.(.+)\.keelsort-[0-9a-f]{32}\.tmp$")


@dataclass(frozen=True)
class FileInfo:
    path: str
    relative: str
    size: int
    modified: int


def check_location(source: str) -> str:
    if "://" in source and re.search(r"[?#]", source):
        raise ValueError("a location has no query or fragment")
    return source


def _path(spark: SparkSession, location: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(check_location(location))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, location: str) -> bool:
    fs, path = _path(spark, location)
    return fs.exists(path)


def is_directory(spark: SparkSession, location: str) -> bool:
    fs, path = _path(spark, location)
    return fs.exists(path) and fs.getFileStatus(path).isDirectory()


def size_of(spark: SparkSession, location: str) -> int:
    fs, path = _path(spark, location)
    return int(fs.getFileStatus(path).getLen())


def delete(spark: SparkSession, location: str) -> None:
    fs, path = _path(spark, location)
    fs.delete(path, True)


def rename(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Move a file; an existing target is an error unless ``overwrite``.

    A file that is replaced is moved aside until the new one is in its place, so that no
    crash leaves neither; it comes back where the move fails.
    """
    fs, a = _path(spark, source)
    _, b = _path(spark, target)
    fs.mkdirs(b.getParent())
    if fs.exists(b):
        if not overwrite:
            raise FileExistsError(target)
        aside = b.suffix(f".{os.urandom(8).hex()}.replaced")
        if not fs.rename(b, aside):
            raise OSError(f"cannot move {target} aside")
        if not fs.rename(a, b):
            fs.rename(aside, b)
            raise OSError(f"cannot move {source} to {target}")
        fs.delete(aside, False)
    elif not fs.rename(a, b):
        raise OSError(f"cannot move {source} to {target}")


def copy(spark: SparkSession, source: str, target: str, overwrite: bool = False) -> None:
    """Byte copy."""
    fs, a = _path(spark, source)
    to, b = _path(spark, target)
    to.mkdirs(b.getParent())
    if to.exists(b) and not overwrite:
        raise FileExistsError(target)
    spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, to, b, False, overwrite, spark._jsc.hadoopConfiguration())


def inventory(spark: SparkSession, source: str) -> list[FileInfo]:
    """Parquet files of a file or tree in order of their paths; hidden ones are skipped. FileNotFoundError where there is none."""
    fs, root = _path(spark, source)
    if not fs.exists(root):
        raise FileNotFoundError(source)
    root = fs.makeQualified(root)
    if not fs.getFileStatus(root).isDirectory():
        s = fs.getFileStatus(root)
        return [FileInfo(root.toString(), root.getName(), int(s.getLen()), int(s.getModificationTime()))]
    found, base = [], root.toString().rstrip("/") + "/"
    listing = fs.listFiles(root, True)
    while listing.hasNext():
        s = listing.next()
        path = s.getPath().toString()
        relative = path[len(base) :]
        if relative.lower().endswith(".parquet") and not any(part[:1] in "._" for part in relative.split("/")):
            found.append(FileInfo(path, relative, int(s.getLen()), int(s.getModificationTime())))
    if not found:
        raise FileNotFoundError(f"no Parquet file in {source}")
    return sorted(found, key=lambda f: f.relative)


def stable(before: Sequence[FileInfo], after: Sequence[FileInfo]) -> bool:
    """Whether two listings have the same files, sizes and times."""
    return [(f.path, f.size, f.modified) for f in before] == [(f.path, f.size, f.modified) for f in after]


FOOTER = "path string, rows long, row_groups int, created_by string, arrow_schema string, metadata string, row_group int, group_rows long, column string, codec string, compressed long, uncompressed long, has_index boolean"


def footers(spark: SparkSession, paths: Iterable[str], parallel: int = 32) -> DataFrame:
    """One row for each (file, row group, leaf column); a file without row groups has one with a null column.

    Footers are read in tasks by Arrow's file systems, a few kilobytes a file.
    """
    paths = list(paths)

    def run(batches):
        import pandas as pd
        import pyarrow.fs as pafs
        import pyarrow.parquet as pq

        for frame in batches:
            rows = []
            for path in frame["path"]:
                fs, own = pafs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                with fs.open_input_file(own) as f:
                    meta = pq.read_metadata(f)
                schema = meta.schema.to_arrow_schema()
                plain = ";".join(f"{x.name}:{x.type}:{x.nullable}" for x in schema)
                kv = json.dumps({k.decode(errors="replace"): v.decode(errors="replace") for k, v in (meta.metadata or {}).items() if k in (PLAN_KEY.encode(), COMPRESSION_KEY.encode(), b"org.apache.spark.sql.parquet.row.metadata")})
                head = (path, meta.num_rows, meta.num_row_groups, meta.created_by, plain, kv)
                for g in range(meta.num_row_groups):
                    group = meta.row_group(g)
                    for c in range(group.num_columns):
                        leaf = group.column(c)
                        rows.append((*head, g, group.num_rows, leaf.path_in_schema, leaf.compression.lower(), leaf.total_compressed_size, leaf.total_uncompressed_size, leaf.has_column_index))
                if not meta.num_row_groups:
                    rows.append((*head, None, None, None, None, None, None, None))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in FOOTER.split(", ")])

    n = max(1, min(parallel, len(paths)))
    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(n).mapInPandas(run, FOOTER)


def footer_inventory(found: DataFrame) -> DataFrame:
    """Rows (column, codec, files, row_groups, compressed, uncompressed) summed over files."""
    return found.where("column is not null").groupBy("column", "codec").agg(
        F.countDistinct("path").alias("files"), F.count(F.lit(1)).alias("row_groups"), F.sum("compressed").alias("compressed"), F.sum("uncompressed").alias("uncompressed")
    )


def check_one_schema(found: DataFrame) -> None:
    """ValueError where files differ in their schemas: a read would drop columns without a word."""
    kinds = found.groupBy("arrow_schema").agg(F.min("path").alias("path")).limit(2).collect()
    if len(kinds) > 1:
        raise ValueError(f"files differ in schema: {kinds[0]['path']} and {kinds[1]['path']}")


def read_parquet(spark: SparkSession, source: str) -> DataFrame:
    """All files of a location under one schema. Files are listed one by one, so directory names add no columns."""
    files = [f.path for f in inventory(spark, source)]
    if len(files) > 1:
        check_one_schema(footers(spark, files))
    return spark.read.parquet(*files)


def spread_indices(total: int, count: int) -> list[int]:
    """Evenly spread positions: the middles of ``count`` equal parts; all where there are no more."""
    if count >= total:
        return list(range(total))
    return [((2 * i + 1) * total) // (2 * count) for i in range(count)]


def weighted_files(rows: Sequence[int], count: int, budget: int) -> dict[int, int]:
    """Files spread by cumulative rows and each one's share of a row budget, in rows.

    A file that two spread points hit gives the second to the widest gap between chosen
    files; shares are equal as far as files have the rows.
    """
    import bisect
    import itertools

    n = len(rows)
    count = min(count, n)
    ends = list(itertools.accumulate(rows))
    chosen: list[int] = []
    for i in range(count):
        at = min(n - 1, bisect.bisect_right(ends, ((2 * i + 1) * ends[-1]) // (2 * count))) if ends and ends[-1] else i
        if at not in chosen:
            chosen.append(at)
    while len(chosen) < count:
        marks = [-1, *sorted(chosen), n]
        low, high = max(zip(marks, marks[1:]), key=lambda g: (g[1] - g[0], -g[0]))
        chosen.append((low + high) // 2)
    share, left = {}, budget
    for k, at in enumerate(sorted(chosen, key=lambda a: (rows[a], a))):
        share[at] = min(rows[at], left // (len(chosen) - k))
        left -= share[at]
    return dict(sorted(share.items()))


def shard_of(relative: str, shards: int) -> int:
    return int.from_bytes(hashlib.sha256(relative.encode()).digest()[:8], "big") % shards


def shard_column(path: Column, shards: int) -> Column:
    """As `shard_of`, on a column."""
    return (F.conv(F.substring(F.sha2(path.cast("string"), 256), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(shards)).cast("int")


def parse_shard(text: str | tuple[int, int]) -> tuple[int, int]:
    """(index, count) of "i/n"."""
    if isinstance(text, str):
        m = re.fullmatch(r"\s*(\d+)\s*/\s*(\d+)\s*", text)
        if not m:
            raise ValueError("a shard is written i/n")
        text = (int(m[1]), int(m[2]))
    i, n = text
    if n < 1 or not 0 <= i < n:
        raise ValueError("a shard i/n has 0 <= i < n")
    return i, n


def parse_size(text: str | int) -> int:
    """Bytes of "6GB", "512MiB", "10k": decimal units, or binary ones with an i."""
    if isinstance(text, int):
        size = text
    else:
        m = re.fullmatch(r"\s*(\d+(?:\.\d+)?)\s*([kmgt]?)(i?)b?\s*", text.lower())
        if not m or (m[3] and not m[2]):
            raise ValueError(f"not a size: {text!r}")
        size = int(float(m[1]) * (1024 if m[3] else 1000) ** " kmgt".index(m[2] or " "))
    if size <= 0:
        raise ValueError("a size is positive")
    return size


@dataclass(frozen=True)
class SourceCompression:
    """Codec of each column and the level where it is known for all files."""

    codecs: dict[str, str]
    levels: dict[str, int | None]

    @property
    def codec(self) -> str | dict[str, str]:
        kinds = set(self.codecs.values())
        return kinds.pop() if len(kinds) == 1 else dict(self.codecs)


def inspect_compression(found: DataFrame, manifest: dict | None = None) -> SourceCompression:
    """Codecs from footers; a level only from a manifest or a file's own provenance with the same codec.

    ValueError where files disagree on a column's codec.
    """
    rows = found.where("column is not null").groupBy("column").agg(F.collect_set("codec").alias("codecs"), F.collect_set("metadata").alias("metadata")).collect()
    codecs, levels = {}, {}
    for r in rows:
        if len(r["codecs"]) > 1:
            raise ValueError(f"column {r['column']!r} has codecs {sorted(r['codecs'])}")
        codec = codecs[r["column"]] = r["codecs"][0]
        seen = set()
        for raw in r["metadata"]:
            own = manifest or _provenance(raw)
            level = own.get("level") if own and str(own.get("codec", "")).lower() == codec else None
            seen.add(level.get(r["column"]) if isinstance(level, dict) else level)
        levels[r["column"]] = seen.pop() if len(seen) == 1 else None
    return SourceCompression(codecs, levels)


def _provenance(raw: str) -> dict | None:
    kv = json.loads(raw or "{}")
    if COMPRESSION_KEY in kv:
        return json.loads(kv[COMPRESSION_KEY])
    fields = json.loads(kv.get("org.apache.spark.sql.parquet.row.metadata", "{}")).get("fields", [])
    own = next((f["metadata"][COMPRESSION_KEY] for f in fields if COMPRESSION_KEY in f.get("metadata", {})), None)
    return json.loads(own) if own else None


def resolve_compression(source: SourceCompression, compression="preserve", level="preserve"):
    """(codec, level) of the output. A codec with levels whose source level is unknown is an error under "preserve"."""
    codec = source.codec if compression == "preserve" else compression
    used = set(codec.values()) if isinstance(codec, dict) else {codec or "none"}
    if not any(k in DEFAULT_LEVELS for k in used):
        return codec, None
    if level != "preserve":
        return codec, effective_level(codec, level)
    if compression != "preserve" and compression != source.codec:
        return codec, effective_level(codec, None)
    unknown = sorted(c for c, k in source.codecs.items() if k in DEFAULT_LEVELS and source.levels.get(c) is None)
    if unknown:
        raise ValueError(f"the compression level of {unknown} is not known: give one, or a manifest")
    if isinstance(codec, dict):
        return codec, {c: source.levels[c] for c, k in codec.items() if k in DEFAULT_LEVELS}
    return codec, next(iter(source.levels.values()))


def effective_level(codec, level):
    """Levels only for codecs that have them; None becomes the concrete default."""
    if isinstance(codec, dict):
        return {c: (level.get(c) if isinstance(level, dict) else level) or DEFAULT_LEVELS[k] for c, k in codec.items() if k in DEFAULT_LEVELS} or None
    if codec not in DEFAULT_LEVELS:
        return None
    return DEFAULT_LEVELS[codec] if level is None else level


def stale_temporaries(spark: SparkSession, folder: str, names: Iterable[str]) -> list[str]:
    """Hidden leftovers of interrupted writes of the named outputs of a folder; those of others may be in work."""
    names = set(names)
    fs, path = _path(spark, folder)
    if not fs.exists(path):
        return []
    return [s.getPath().toString() for s in fs.listStatus(path) if (m := TEMPORARY.match(s.getPath().getName())) and m[1] in names]
