"""Helpers shared by the operators of this package.

Every helper works on DataFrames of any size; what it sends to all tasks or to
the driver has a fixed size bound, stated where it is made.
"""

from __future__ import annotations

import functools
import itertools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keelsort.session import settle

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
WORD_BREAK = "[ \\t-\\r]+"


def input_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate; for file scans the bytes of the files."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def parts_for(df: DataFrame, bytes_each: int, least: int = 1) -> int:
    """A partition count that grows with the input so that each part stays within ``bytes_each``.

    Where Spark does not know the size (rows that come from no file), the session's number
    of shuffle partitions.
    """
    size = input_bytes(df)
    if size >= 1 << 55:
        return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return max(least, math.ceil(size / bytes_each))


#: Bounds of the filter below: 8 kB to 4 MB of bits, half a million rows to all tasks at most, whatever the input.
LEAST_WORDS, MOST_WORDS = 1 << 10, 1 << 19


def _hash_of(keys) -> F.Column:
    return F.xxhash64(*[F.col(k) for k in keys])


def _listed(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def bounded_filter(keys: DataFrame, key, words: int) -> DataFrame:
    """A bit set over the hashes of ``key`` (a column or several): at most ``words`` rows (word, bits)."""
    h = _hash_of(_listed(key))
    return (
        keys.select(F.pmod(h, F.lit(words)).cast("int").alias("_keelsort_word"), F.pmod(F.shiftright(h, 24), F.lit(64)).cast("int").alias("_keelsort_bit"))
        .groupBy("_keelsort_word")
        .agg(F.expr("bit_or(shiftleft(1L, _keelsort_bit))").alias("_keelsort_bits"))
    )


def _marked(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """``df`` with whether its ``key`` may be in ``keys``.

    The filter has 16 bits a key (counted), up to MOST_WORDS; with far more keys it lets
    more rows pass, which cost a shuffle and no result.
    """
    words = LEAST_WORDS
    n = keys.count()
    while words < MOST_WORDS and words * 4 < n:
        words *= 2
    small = F.broadcast(bounded_filter(keys, key, words))
    h = _hash_of(_listed(key))
    held = df.withColumn("_keelsort_hash", h).withColumn("_keelsort_word", F.pmod("_keelsort_hash", F.lit(words)).cast("int")).join(small, "_keelsort_word", "left")
    bit = F.call_function("shiftright", F.col("_keelsort_bits"), F.pmod(F.shiftright("_keelsort_hash", 24), F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return held.withColumn("_keelsort_maybe", F.coalesce(bit, F.lit(False)))


def semi_by_filter(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Rows of ``df`` whose ``key`` (a column or several) may be in ``keys``; a superset, pruned before any shuffle.

    Follow with an exact join.
    """
    return _marked(df, keys, key).where("_keelsort_maybe").select(df.columns)


def split_by_filter(df: DataFrame, keys: DataFrame, key) -> tuple[DataFrame, DataFrame]:
    """What `semi_by_filter` gives, and the other rows of ``df``: surely not in ``keys``."""
    marked = _marked(df, keys, key)
    return marked.where("_keelsort_maybe").select(df.columns), marked.where("not _keelsort_maybe").select(df.columns)


def without(df: DataFrame, keys: DataFrame, key) -> DataFrame:
    """Exact anti join on ``key`` (a column or several) that shuffles only the rows which may be in ``keys``; null keys are in no table."""
    key = _listed(key)
    maybe, rest = split_by_filter(df, keys, key)
    return rest.unionByName(maybe.join(keys.select(key).distinct(), key, "left_anti").select(df.columns))


def plain_names(df: DataFrame):
    """``df`` with its columns named c0, c1, ..., and a function that gives a frame with these columns the names of ``df`` again."""
    own = [f"c{i}" for i in range(len(df.columns))]
    return df.toDF(*own), lambda out: out.select(own).toDF(*df.columns)


def tidy() -> None:
    """Give freed memory back to the system: a worker that is used again would keep the peak of every stage."""
    import ctypes

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def tidied(function):
    """A function over batches or one table that calls `tidy` after each of its batches, or at its end."""

    @functools.wraps(function)
    def run(given, *more):
        out = function(given, *more)
        if isinstance(out, pa.Table):
            tidy()
            return out
        return _after_each(out)

    return run


def _after_each(out):
    held = 0
    for made in out:
        yield made
        held += 1
        if held % 8 == 0:
            del made
            tidy()
    tidy()


def slices(batch: pa.RecordBatch, column: str, max_bytes: int):
    """Split a record batch by rows so that ``column`` holds about ``max_bytes`` in each part."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    lengths = np.asarray(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    ends = np.cumsum(lengths)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = int(np.searchsorted(ends, base + max_bytes, side="right"))
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def texts_of(batch: pa.RecordBatch, column: str) -> pa.Array:
    """The column as large_string, null as empty, with its bytes from offset 0: some kernels misread slices."""
    col = pc.fill_null(pc.cast(batch.column(batch.schema.get_field_index(column)), pa.large_string()), "")
    if not len(col):
        return pa.array([], pa.large_string())
    buffers = col.buffers()
    ends = np.frombuffer(buffers[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    if ends[0] == 0 and col.offset == 0:
        return col
    size = int(ends[-1] - ends[0])
    data = buffers[2].slice(int(ends[0]), size) if buffers[2] is not None else pa.py_buffer(b"")
    return pa.LargeStringArray.from_buffers(len(col), pa.py_buffer(ends - ends[0]), data)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words by the rule ``[^\\x20\\x09-\\x0D]+`` of all texts in a row, and the offsets of each text's words."""
    lists = pc.ascii_split_whitespace(texts)
    flat = pc.list_flatten(lists)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    offsets = offsets - offsets[0]
    keep = np.asarray(pc.binary_length(flat)) > 0
    if not keep.all():
        before = np.concatenate([[0], np.cumsum(keep)])
        offsets = before[offsets]
        flat = flat.filter(pa.array(keep))
    return flat, offsets


_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser with full avalanche over 64-bit lanes."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


def hash_strings(values: pa.Array) -> np.ndarray:
    """64-bit hash of each (distinct) string."""
    import xxhash

    h = xxhash.xxh3_64_intdigest
    return np.fromiter((h(v) for v in values.cast(pa.large_binary()).to_pylist()), dtype=np.uint64, count=len(values))


def word_hashes(flat: pa.Array) -> np.ndarray:
    """64-bit hash of each word; each distinct word is hashed once."""
    if len(flat) == 0:
        return np.zeros(0, dtype=np.uint64)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return hash_strings(coded.dictionary)[np.asarray(coded.indices)]


def components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected edge list: rows (node, component), component the smallest node.

    Distributed union-find: every round hooks the label of each edge's end to the
    smaller label of the other end and then jumps pointers once, so a component of
    diameter d is settled in O(log d) rounds. Each round is written to the shared
    folder; only one count a round comes to the driver. Self loops and repeated
    edges are allowed; an empty list gives an empty result.
    """
    both = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a is not null and b is not null")
    both = settle(both.union(both.select("b", "a")))
    # the label of a node is the smallest node seen so far
    labels = settle(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("label")).select(F.col("a").alias("node"), "label"))
    for _ in range(max_rounds):
        # smallest label among the neighbours, aggregated before the join on the node
        near = (
            both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
            .groupBy("a")
            .agg(F.min("lb").alias("near"))
        )
        hooked = labels.join(near, labels.node == near.a, "left").select("node", F.col("label").alias("was"), F.least("label", F.coalesce("near", "label")).alias("label"))
        # hook the old label's node as well, so that whole trees move at once
        moved = hooked.groupBy(F.col("was").alias("root")).agg(F.min("label").alias("to"))
        jumped = (
            hooked.join(moved, hooked.was == moved.root, "left")
            .select("node", "was", F.least("label", F.coalesce("to", "label")).alias("label"))
        )
        jumped = settle(jumped)
        changed = jumped.where("label <> was").limit(1).count()
        labels = jumped.select("node", "label")
        if not changed:
            break
    else:
        raise RuntimeError("components did not settle")
    return labels.select("node", F.col("label").alias("component"))


def grouped(batches, key: str):
    """Rows of a stream sorted by ``key`` as (key, table) with all rows of the key together.

    Holds one group at a time; callers bound the group's size beforehand.
    """
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        if batch.num_rows == 0:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
        at = 0
        for value, run in itertools.groupby(keys):
            n = sum(1 for _ in run)
            part = batch.slice(at, n)
            at += n
            if held and value != current:
                yield current, pa.Table.from_batches(held)
                held = []
            current = value
            held.append(part)
    if held:
        yield current, pa.Table.from_batches(held)
