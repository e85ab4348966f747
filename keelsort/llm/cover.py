"""Substring dedup by difference-cover anchors.

Positions of a difference cover modulo a period are the only ones that are hashed:
for any two positions i and j some shift below the period puts both on the cover. A
match of a window's length therefore shares an anchor that lies on the cover in both
texts. Anchors of more than one text are then extended: the windows around them are
compared by a 96-bit hash of all their words, and words of a window that a text of
smaller identifier has are removed. Copies of a whole text are told by 128 bits of
hash and the length; a row is known by a 64-bit hash of its identifier and text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keelsort.llm.common import mix, parts_for, semi_by_filter, settle, slices, split_by_filter, texts_of, tidied, without, word_hashes, words_of

#: A perfect difference cover and its period.
COVER, PERIOD = (0, 1, 3), 7
WINDOW = 13
#: Text bytes that a task takes apart at once.
BATCH_BYTES = 4_000_000
#: Input bytes for each bucket of hashes; the number of buckets grows with the input.
BUCKET_BYTES = 4_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def rolling(h: np.ndarray, n: int, step: np.uint64 = _STEP) -> np.ndarray:
    """Hash of each run of ``n`` word hashes (order counts); shorter than ``h`` by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for k in range(1, n):
        out *= step
        out += h[k : len(h) - n + 1 + k]
    return mix(out)


def _packed(bucket: np.ndarray, columns: list[np.ndarray], names: list[str]):
    """One row for each bucket with the columns' values as bytes."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    cut = np.flatnonzero(np.diff(bucket)) + 1
    starts = np.concatenate([[0], cut]) if len(bucket) else np.zeros(0, np.int64)
    ends = np.concatenate([cut, [len(bucket)]]) if len(bucket) else starts
    arrays = [pa.array(bucket[starts].astype(np.int32))]
    for c in columns:
        c = c[order]
        arrays.append(pa.array([c[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist())], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, names=["bucket", *names])


def _anchors(buckets: int, window: int):
    size = window - PERIOD + 1

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                flat, offsets = words_of(texts_of(part, "text"))
                if len(flat) < window:
                    continue
                h = word_hashes(flat)
                n = np.diff(offsets)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(h)) - offsets[:-1][doc]
                ok = (n[doc] - place >= size) & (n[doc] >= window) & np.isin(place % PERIOD, COVER)
                at = np.flatnonzero(ok)
                roll = rolling(h, size)[at]
                key = part.column(0).to_numpy(zero_copy_only=False)[doc[at]]
                yield _packed((roll % np.uint64(buckets)).astype(np.int64), [roll, key.astype(np.int64), place[at].astype(np.int32)], ["hash", "key", "place"])

    return run


def _joined(table: pa.Table, name: str, dtype) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), dtype=dtype)


def _by_key(key: np.ndarray, place: np.ndarray) -> pa.Table:
    order = np.lexsort((place, key))
    key, place = key[order], place[order]
    cut = np.flatnonzero(np.diff(key)) + 1
    starts = np.concatenate([[0], cut]).astype(np.int32) if len(key) else np.zeros(0, np.int32)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([starts, [len(key)]]).astype(np.int32)), pa.array(place, pa.int32()))
    return pa.table({"key": pa.array(key[starts], pa.int64()), "places": lists})


def _slots(key: np.ndarray, place: np.ndarray, slots: int) -> pa.Table:
    """Places dealt by their key to slots, packed: as many rows as slots, however many keys."""
    return pa.Table.from_batches([_packed((mix(key.view(np.uint64)) % np.uint64(slots)).astype(np.int64), [key, place], ["key", "place"]).rename_columns(["slot", "key", "place"])])


def _gathered(table: pa.Table) -> pa.Table:
    """All places of each key of a slot."""
    return _by_key(_joined(table, "key", np.int64), _joined(table, "place", np.int32))


def _shared(table: pa.Table, slots: int) -> pa.Table:
    """Places of anchors that more than one text has."""
    h, key, place = _joined(table, "hash", np.uint64), _joined(table, "key", np.int64), _joined(table, "place", np.int32)
    order = np.argsort(h, kind="stable")
    h, key, place = h[order], key[order], place[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    group = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    low, high = np.minimum.reduceat(key, starts), np.maximum.reduceat(key, starts)
    keep = (low != high)[group]
    return _slots(key[keep], place[keep], slots)


def _windows(buckets: int, window: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                flat, offsets = words_of(texts_of(part, "text"))
                if len(flat) < window:
                    continue
                h = word_hashes(flat)
                n = np.diff(offsets)
                places = part.column(part.schema.get_field_index("places"))
                count = np.asarray(pc.fill_null(pc.list_value_length(places), 0))
                doc_of = np.repeat(np.arange(len(n)), count)
                at = offsets[:-1][doc_of] + np.asarray(pc.list_flatten(places)).astype(np.int64)
                # windows that hold a shared anchor start on it or up to PERIOD - 1 words before
                begin = np.zeros(len(h) + 1, dtype=np.int32)
                np.add.at(begin, np.maximum(at - (PERIOD - 1), offsets[:-1][doc_of]), 1)
                np.add.at(begin, at + 1, -1)
                doc = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(h)) - offsets[:-1][doc]
                start = np.flatnonzero((np.cumsum(begin[:-1]) > 0) & (n[doc] - place >= window))
                if not len(start):
                    continue
                a = rolling(h, window)[start]
                b = (rolling(mix(h ^ _OTHER), window, _OTHER)[start] >> np.uint64(32)).astype(np.uint32)
                key = part.column(0).to_numpy(zero_copy_only=False)[doc[start]]
                ids = part.column(1).to_numpy(zero_copy_only=False)[doc[start]]
                yield _packed((a % np.uint64(buckets)).astype(np.int64), [a, b, key.astype(np.int64), ids.astype(np.int64), place[start].astype(np.int32)], ["a", "b", "key", "id", "place"])

    return run


def _repeats(table: pa.Table, slots: int) -> pa.Table:
    """Starts of windows that a text with a smaller identifier has too."""
    a, b = _joined(table, "a", np.uint64), _joined(table, "b", np.uint32)
    key, ids, place = _joined(table, "key", np.int64), _joined(table, "id", np.int64), _joined(table, "place", np.int32)
    order = np.lexsort((b, a))
    a, b, key, ids, place = a[order], b[order], key[order], ids[order], place[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    starts = np.flatnonzero(new)
    least = np.minimum.reduceat(ids, starts)[np.cumsum(new) - 1]
    keep = ids > least
    return _slots(key[keep], place[keep], slots)


def _row_key():
    return F.xxhash64("doc_id", "text", F.lit(5))


def repeated_windows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Rows (key, places, whole) of ``docs(doc_id, text, key)`` that hold a window which a smaller doc_id has.

    ``places`` are the starts of such windows. A text that a smaller doc_id has from end
    to end has ``whole`` instead: copies of a text are set aside first, so that a text
    which many rows share is taken apart once.
    """
    if window < PERIOD + 1:
        raise ValueError(f"a window has more than {PERIOD} words")
    buckets = parts_for(docs, BUCKET_BYTES)
    digests = settle(docs.select("doc_id", "key", F.xxhash64("text", F.lit(1)).alias("d1"), F.xxhash64(F.lit(2), "text").alias("d2"), F.octet_length("text").alias("d3")))
    # written before the join, so that the rows of one text can be split over tasks
    many = settle(digests.groupBy("d1", "d2", "d3").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("m")).where("m > 1"))
    copies = settle(digests.join(many, ["d1", "d2", "d3"]).where("doc_id > least").select("key")).distinct()
    own = without(docs, copies, "key")
    anchors = own.select("key", "text").mapInArrow(tidied(_anchors(buckets, window)), "bucket int, hash binary, key binary, place binary")
    packed, listed = "slot int, key binary, place binary", "key long, places array<int>"
    shared = anchors.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidied(lambda t: _shared(t, buckets)), packed)
    shared = settle(shared.repartition(buckets, "slot").groupBy("slot").applyInArrow(tidied(_gathered), listed))
    held = semi_by_filter(docs, shared, "key").join(shared, "key").select("key", "doc_id", "text", "places")
    found = held.mapInArrow(tidied(_windows(buckets, window)), "bucket int, a binary, b binary, key binary, id binary, place binary")
    found = found.repartition(buckets, "bucket").groupBy("bucket").applyInArrow(tidied(lambda t: _repeats(t, buckets)), packed)
    found = found.repartition(buckets, "slot").groupBy("slot").applyInArrow(tidied(_gathered), listed)
    return settle(found.withColumn("whole", F.lit(False)).unionByName(copies.withColumn("places", F.expr("cast(array() as array<int>)")).withColumn("whole", F.lit(True))))


def _cut(texts: pa.Array, places, whole, window: int):
    """Words kept of each text: joined text, number of words, number removed."""
    flat, offsets = words_of(texts)
    n = np.diff(offsets)
    gone = np.zeros(len(flat) + 1, dtype=np.int32)
    if places is not None:
        count = np.asarray(pc.fill_null(pc.list_value_length(places), 0))
        doc_of = np.repeat(np.arange(len(n)), count)
        at = offsets[:-1][doc_of] + np.asarray(pc.list_flatten(places)).astype(np.int64)
        np.add.at(gone, at, 1)
        np.add.at(gone, at + window, -1)
        full = np.flatnonzero(np.asarray(whole) & (n >= window))
        np.add.at(gone, offsets[full], 1)
        np.add.at(gone, offsets[full + 1], -1)
    keep = np.cumsum(gone[:-1]) == 0
    before = np.concatenate([[0], np.cumsum(keep)])
    lists = pa.LargeListArray.from_arrays(pa.array(before[offsets]), flat.filter(pa.array(keep)) if len(flat) else flat)
    joined = pc.binary_join(lists.cast(pa.list_(pa.large_string())), pa.scalar(" ", pa.large_string()))
    return joined, n, n - np.diff(before[offsets])


def _each(docs: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """Rows that hold a repeated window, with places and whole, and all others."""
    marks = repeated_windows(docs.select("doc_id", "text", "key"), window)
    # a row that repeats another has its key: marks are distinct by key
    maybe, rest = split_by_filter(docs, marks, "key")
    return maybe.join(marks, "key", "left"), rest


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("key", _row_key())


def removal_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256), one for each row of ``docs``.

    Words are runs of characters other than ASCII white space; null text has none. Each
    word is removed that a window of ``window`` words covers whose words also start in
    a text with a smaller doc_id; windows are judged on the input. A row whose doc_id
    is null takes no part in comparisons and keeps its words. Other columns are not
    read.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                marked = part.schema.get_field_index("places")
                places = whole = None
                if marked >= 0:
                    places, whole = part.column(marked), pc.fill_null(part.column(part.schema.get_field_index("whole")), False)
                    whole = whole.to_numpy(zero_copy_only=False)
                joined, n, removed = _cut(texts_of(part, "text"), places, whole, window)
                sha = [hashlib.sha256(x.as_buffer()).hexdigest() for x in joined]
                yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")), pa.array(n), pa.array(removed), pa.array(sha, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    keyed = _keyed(docs, id_col, text_col)
    known = keyed.where("doc_id is not null")
    with_marks, plain = _each(known, window)
    return (
        with_marks.select("doc_id", "text", "places", "whole").mapInArrow(tidied(run), out)
        .unionByName(plain.unionByName(keyed.where("doc_id is null")).select("doc_id", "text").mapInArrow(tidied(run), out))
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``docs`` with the words removed that `removal_digests` counts; all columns and rows stay.

    A text that loses words becomes the kept ones joined by one space; any other text
    stays as it is, null too.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    # plain names within: any name is allowed in docs
    inner = [f"c{i}" for i in range(len(names))]
    plain = docs.toDF(*inner)
    doc_id, text = F.col(f"c{names.index(id_col)}").cast("long"), F.coalesce(F.col(f"c{at}").cast("string"), F.lit(""))
    keyed = plain.withColumn("key", F.xxhash64(doc_id, text, F.lit(5)))
    marks = repeated_windows(_keyed(docs, id_col, text_col).where("doc_id is not null"), window)

    def run(batches):
        for batch in batches:
            for part in slices(batch, f"c{at}", BATCH_BYTES):
                texts = part.column(at)
                places, whole = part.column(len(names)), part.column(len(names) + 1)
                joined, _, removed = _cut(texts_of(part, f"c{at}"), places, pc.fill_null(whole, False).to_numpy(zero_copy_only=False), window)
                new = pc.if_else(pa.array(removed > 0), joined.cast(texts.type), texts)
                columns = [new if i == at else part.column(i) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays(columns, names=inner)

    maybe, rest = split_by_filter(keyed, marks, "key")
    touched = maybe.join(marks, "key", "left").select(*plain.columns, "places", "whole")
    return rest.select(*plain.columns).unionByName(touched.mapInArrow(tidied(run), plain.schema)).toDF(*names)
