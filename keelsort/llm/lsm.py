"""Exact dedup by a log-structured merge index of digests.

Each task ingests its rows into a memtable (digest -> texts); a digest that hits the
memtable is verified byte by byte, and a full memtable is flushed as rows sorted by
digest. What merges the flushed memtables of all tasks is a Spark aggregation by entry
and then by digest, in place of runs with filters, compaction within a task and a
sorted merge: `exact_groups` builds no `Run` and calls no `compact`. Digests of more
than one entry are hits whose texts are fetched, one for each entry, and compared byte
by byte. `Run`, `compact` and `lookup` serve an index that a caller loads; `lookup`
goes by digests and does not compare bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from keelsort.llm.common import plain_names, semi_by_filter, settle, without

#: Bytes of distinct texts that a memtable holds before it is flushed.
MEMTABLE_BYTES = 24_000_000
#: Bits of a run's filter for each digest, and probes.
FILTER_BITS, FILTER_PROBES = 10, 4


class Run:
    """A flushed run: digests in sorted order with the identifier that stands for each, and a Bloom filter."""

    def __init__(self, digests: np.ndarray, owners: np.ndarray):
        order = np.argsort(digests, kind="stable")
        self.digests, self.owners = digests[order], owners[order]
        bits = 64
        while bits < FILTER_BITS * max(1, len(digests)):
            bits *= 2
        self.mask = np.uint64(bits - 1)
        self.filter = np.zeros(bits // 8, dtype=np.uint8)
        for at in self._probes(self._lanes(self.digests)):
            np.bitwise_or.at(self.filter, at >> np.uint64(3), np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8)))

    @staticmethod
    def _lanes(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.frombuffer(np.ascontiguousarray(digests).tobytes(), dtype="<u8").reshape(-1, 4)
        return words[:, 0], words[:, 1] | np.uint64(1)

    def _probes(self, lanes):
        a, b = lanes
        for k in range(FILTER_PROBES):
            yield (a + np.uint64(k) * b) & self.mask

    def may_hold(self, digests: np.ndarray) -> np.ndarray:
        """Which digests may be in the run: no false negatives."""
        out = np.ones(len(digests), dtype=bool)
        for at in self._probes(self._lanes(digests)):
            out &= (self.filter[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out

    def find(self, digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions among ``digests`` that the run holds, and their owners there; the filter is asked first."""
        maybe = np.flatnonzero(self.may_hold(digests))
        if not len(maybe) or not len(self.digests):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.searchsorted(self.digests, digests[maybe])
        at[at == len(self.digests)] = 0
        hit = self.digests[at] == digests[maybe]
        return maybe[hit], self.owners[at[hit]]


def compact(runs: list[Run]) -> Run:
    """Merge runs to one; of equal digests the smallest owner stays."""
    digests = np.concatenate([r.digests for r in runs])
    owners = np.concatenate([r.owners for r in runs])
    order = np.lexsort((owners, digests))
    digests, owners = digests[order], owners[order]
    first = np.ones(len(digests), dtype=bool)
    first[1:] = digests[1:] != digests[:-1]
    return Run(digests[first], owners[first])


def ingest(docs: DataFrame, memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """Rows (digest, doc_id, entry, run) of docs(doc_id, text): ``entry`` names the text within its run.

    Rows of a run with equal bytes share an entry; a run is a flushed memtable, its
    rows come out sorted by digest. Texts of equal digest and other bytes get entries of
    their own.
    """

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        state = {"run": 0}

        def fresh():
            return {}, [], [], [], 0

        table, digests, ids, entries, held = fresh()

        def flush():
            base = (part << 34) + (state["run"] << 24)
            state["run"] += 1
            d = np.array(digests, dtype="S32")
            order = np.argsort(d, kind="stable")
            at = order.tolist()
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([digests[i] for i in at], pa.binary()),
                    pa.array([ids[i] for i in at], pa.int64()),
                    pa.array([base + entries[i] for i in at], pa.int64()),
                    pa.array([base] * len(at), pa.int64()),
                ],
                names=["digest", "doc_id", "entry", "run"],
            )

        sha, n = hashlib.sha256, 0
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            for doc, text in zip(batch.column(0).to_pylist(), texts):
                raw = text.as_buffer()
                raw = b"" if raw is None else raw.to_pybytes()
                digest = sha(raw).digest()
                known = table.get(digest)
                if known is None:
                    table[digest] = [(raw, len(table))]
                    held += len(raw) + 200
                    entry = len(table) - 1
                else:
                    entry = next((e for other, e in known if other == raw), None)
                    if entry is None:  # equal digest, other bytes
                        entry = (1 << 23) + n
                        n += 1
                        known.append((raw, entry))
                digests.append(digest)
                ids.append(doc)
                entries.append(entry)
                if held > memtable_bytes or len(ids) >= 1 << 22:
                    yield flush()
                    table, digests, ids, entries, held = fresh()
                    n = 0
        if ids:
            yield flush()

    return docs.mapInArrow(run, "digest binary, doc_id long, entry long, run long")


def exact_groups(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text", memtable_bytes: int = MEMTABLE_BYTES) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, kept, text_sha256), one for each row of ``docs``.

    Texts are equal when their bytes are; null counts as empty. Of equal texts the row
    with the smallest or largest identifier stays (``keep``: "min" or "max"); of rows
    that repeat an identifier all are kept or none. Other columns are not read.

    The first scan writes digests only. A row is then joined to its entry's verdict;
    an entry has the rows of one memtable, so a text that a third of all rows have is
    spread over as many entries as there are memtables.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = settle(ingest(docs, memtable_bytes))
    pick = F.min if keep == "min" else F.max
    entries = settle(rows.groupBy("entry").agg(F.first("digest").alias("digest"), pick("doc_id").alias("owner"), F.count(F.lit(1)).alias("n")))
    merged = entries.groupBy("digest").agg(pick("owner").alias("keep_id"), F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("m"))
    # hits: entries whose digest is in more than one run; one text of each is compared with that of the row that stays
    hits = settle(entries.join(merged.where("m > 1"), "digest").select("entry", "digest", "owner", "keep_id", "group_size"))
    wanted = hits.select(F.col("owner").alias("doc_id")).distinct()
    texts = semi_by_filter(docs, wanted, "doc_id").join(wanted, "doc_id", "left_semi")
    texts = texts.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("raw"))
    # one text for each identifier and digest, so that rows that repeat an identifier do not multiply
    texts = texts.withColumn("digest", F.unhex(F.sha2("raw", 256))).groupBy("doc_id", "digest").agg(F.first("raw").alias("raw"))
    kept = texts.join(hits.select(F.col("keep_id").alias("doc_id"), "digest").distinct(), ["doc_id", "digest"], "left_semi").select("digest", F.col("raw").alias("kept_raw"))
    checked = (
        hits.join(texts.select(F.col("doc_id").alias("owner"), "digest", "raw"), ["owner", "digest"])
        .join(kept, "digest")
        .select("entry", "digest", "owner", "raw", (F.col("raw") == F.col("kept_raw")).alias("same"))
    )
    verdict = hits.select("entry", "keep_id", "group_size")
    apart = settle(checked.where("not same").select("digest").distinct())
    if apart.limit(1).count():
        # digests that stand for several texts: their entries are grouped by the texts
        mixed = checked.join(apart, "digest", "left_semi").join(entries.select("entry", "n"), "entry")
        w = Window.partitionBy("digest", "raw")
        own = mixed.select("entry", pick("owner").over(w).alias("keep_id"), F.sum("n").over(w).alias("group_size"))
        verdict = verdict.join(own, "entry", "left_anti").unionByName(own)
    alone = entries.join(hits.select("entry"), "entry", "left_anti").select("entry", F.col("owner").alias("keep_id"), F.col("n").alias("group_size"))
    verdict = verdict.unionByName(alone)
    return rows.join(verdict, "entry").select(
        "doc_id",
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def without_copies(docs: DataFrame, keep: str = "min", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that `exact_groups` does not keep.

    Rows go by identifier and text, so a row stays whose identifier repeats with another
    text. Rows with a null identifier stay; any column names are allowed.
    """
    gone = settle(exact_groups(docs, keep, id_col, text_col).where("doc_id <> keep_id").select("doc_id", "text_sha256").distinct())
    plain, back = plain_names(docs)
    at_id, at_text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    marked = plain.withColumn("doc_id", at_id.cast("long")).withColumn("text_sha256", F.sha2(F.coalesce(at_text.cast("string"), F.lit("")).cast("binary"), 256))
    return back(without(marked, gone, ["doc_id", "text_sha256"]))


def lookup(docs: DataFrame, runs: list[Run], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, owner) of texts whose digest is in a loaded index of runs; newest run first.

    The runs are sent to every task: use it for increments against one bounded level
    of an index, and `exact_groups` for whole tables.
    """

    def run(batches):
        for batch in batches:
            raw = [b"" if t is None else t for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            d = np.array([hashlib.sha256(t).digest() for t in raw], dtype="V32").view("S32")
            owner = np.full(len(raw), -1, dtype=np.int64)
            for level in runs:
                at, own = level.find(d)
                owner[at] = np.where(owner[at] < 0, own, owner[at])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(owner, mask=owner < 0)], names=["doc_id", "owner"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, owner long")
