"""Stupid-backoff language-model scores, computed relationally.

Texts are dealt to chunks. A chunk explodes its texts to n-grams, counts the distinct
ones and sends them to hash partitions; a hash partition sums the counts of all chunks
(its part of the n-gram count tables) and joins them back to the chunks that asked.
A chunk then has the corpus count of each of its n-grams, scores every word and sums
the scores per document. N-grams travel packed, sorted by hash, one array for each
chunk and partition.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelsort.llm.common import mix, parts_for, texts_of, word_hashes, words_of

ORDER, BACKOFF, LEAST_COUNT = 2, 0.4, 2
#: Input bytes of a chunk, and of a hash partition's share.
CHUNK_BYTES, PART_BYTES = 4_000_000, 8_000_000
_STEP = np.uint64(0x9E3779B97F4A7C15)
#: Stands for the empty n-gram, whose count is the number of words.
_EMPTY = np.uint64(0)


def grams(texts: pa.Array, order: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For n = 1..order the hash of the n-gram that ends at each word, 0 where the text has no n words yet; each word's text; offsets."""
    flat, offsets = words_of(texts)
    h = word_hashes(flat)
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(h)) - offsets[:-1][doc]
    out, run = [], np.zeros(len(h), np.uint64)
    for k in range(1, order + 1):
        # the run that ends here is the one that ended a word before, and this word
        before = np.zeros(len(h), np.uint64)
        if k > 1 and len(h) > 1:
            before[1:] = run[:-1]
        run = before * _STEP + h
        g = mix(run + np.uint64(k))
        g[g == _EMPTY] = np.uint64(1)
        out.append(np.where(place >= k - 1, g, _EMPTY))
        run = np.where(place >= k - 1, run, np.uint64(0))
    return out, doc, offsets


def _asked(gs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found = np.concatenate([g[g != _EMPTY] for g in gs]) if gs else np.zeros(0, np.uint64)
    keys, counts = np.unique(found, return_counts=True)
    return np.concatenate([[_EMPTY], keys]), np.concatenate([[len(gs[0]) if gs else 0], counts]).astype(np.int64)


def _part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """Ranges of the hash: sorted keys have ascending partitions."""
    return ((keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def _request(order: int, parts: int):
    def run(group: pa.Table) -> pa.Table:
        batch = group.combine_chunks().to_batches()
        gs, _, _ = grams(texts_of(batch[0], "text"), order) if batch else ([], None, None)
        keys, counts = _asked(gs)
        part = _part_of(keys, parts)
        cut = np.flatnonzero(np.diff(part)) + 1
        starts, ends = np.concatenate([[0], cut]).tolist(), np.concatenate([cut, [len(keys)]]).tolist()
        small = counts.astype(np.uint32)
        return pa.table(
            {
                "chunk": pa.array([group.column("chunk")[0].as_py()] * len(starts), pa.int32()),
                "part": pa.array(part[starts].astype(np.int32)),
                "grams": pa.array([keys[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
                "counts": pa.array([small[s:e].tobytes() for s, e in zip(starts, ends)], pa.binary()),
            }
        )

    return run


def _totals(table: pa.Table):
    raw = table.column("grams").to_pylist()
    keys = np.frombuffer(b"".join(raw), np.uint64)
    counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.uint32).astype(np.int64)
    order = np.argsort(keys, kind="stable")
    new = np.ones(len(keys), dtype=bool)
    new[1:] = keys[order][1:] != keys[order][:-1]
    sums = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(keys) else np.zeros(0, np.int64)
    return raw, keys, order, new, sums


def _reply(table: pa.Table) -> pa.Table:
    raw, keys, order, new, sums = _totals(table)
    total = np.empty(len(keys), np.int64)
    total[order] = sums[np.cumsum(new) - 1]
    ends = np.cumsum([len(x) // 8 for x in raw])
    small = [_pack(total[e - len(x) // 8 : e]) for x, e in zip(raw, ends.tolist())]
    return pa.table({"chunk": table.column("chunk"), "part": table.column("part"), "totals": pa.array(small, pa.binary())})


def _pack(x: np.ndarray) -> bytes:
    """Counts in four bytes where they fit, else in eight; the first byte tells."""
    return b"\x04" + x.astype(np.uint32).tobytes() if not len(x) or x.max() < 1 << 32 else b"\x08" + x.astype(np.uint64).tobytes()


def _unpack(x: bytes) -> np.ndarray:
    return np.frombuffer(x[1:], np.uint32 if x[:1] == b"\x04" else np.uint64).astype(np.int64)


def word_scores(gs: list[np.ndarray], count, total: int, backoff: float, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Log score of each word, and how often it backed off; ``count`` maps hashes to corpus counts."""
    n = len(gs[0])
    score, left, times = np.zeros(n), np.ones(n, dtype=bool), np.zeros(n, np.int64)
    counts = [count(g) for g in gs]
    for k in range(len(gs), 1, -1):
        g, c = gs[k - 1], counts[k - 1]
        possible = left & (g != _EMPTY)
        seen = possible & (c >= least)
        # the context ends a word before
        context = np.zeros(n, np.int64)
        context[1:] = counts[k - 2][:-1]
        score[seen] += np.log(c[seen] / context[seen])
        left &= ~seen
        score[possible & ~seen] += np.log(backoff)
        times[possible & ~seen] += 1
    score[left] += np.log(counts[0][left] / max(1, total))
    return score, times


def _score(order: int, backoff: float, least: int):
    def run(docs: pa.Table, replies: pa.Table) -> pa.Table:
        batch = docs.combine_chunks().to_batches()
        if not batch:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_backoff": pa.array([], pa.int64()), "log_score": pa.array([], pa.float64())})
        gs, doc, offsets = grams(texts_of(batch[0], "text"), order)
        keys, _ = _asked(gs)
        by_part = sorted(zip(replies.column("part").to_pylist(), replies.column("totals").to_pylist()))
        totals = np.concatenate([_unpack(x) for _, x in by_part])
        size = len(offsets) - 1
        score, times = np.zeros(0), np.zeros(0)
        if len(gs[0]):
            score, times = word_scores(gs, lambda g: totals[np.searchsorted(keys, g)] * (g != _EMPTY), int(totals[0]), backoff, least)
        return pa.table(
            {
                "doc_id": batch[0].column(batch[0].schema.get_field_index("doc_id")),
                "n_words": pa.array(np.diff(offsets)),
                "n_backoff": pa.array(np.bincount(doc, times, size).astype(np.int64)),
                "log_score": pa.array(np.bincount(doc, score, size)),
            }
        )

    return run


def _chunked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    chunks, parts = parts_for(docs, CHUNK_BYTES), parts_for(docs, PART_BYTES)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # copies of a text go to different chunks, so no chunk has a group of copies
    return own.select(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text"), parts


def ngram_counts(docs: DataFrame, order: int = ORDER, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_COUNT) -> DataFrame:
    """The count tables: rows (gram, count) of hashed n-grams, n = 1..``order``, seen ``least`` times or more; gram 0 is the number of words."""
    chunked, parts = _chunked(docs, id_col, text_col)

    def sums(table: pa.Table) -> pa.Table:
        _, keys, at, new, total = _totals(table)
        own = keys[at][new]
        keep = (total >= least) | (own == _EMPTY)
        return pa.table({"gram": pa.array(own[keep].view(np.int64)), "count": pa.array(total[keep])})

    asked = chunked.groupBy("chunk").applyInArrow(_request(order, parts), "chunk int, part int, grams binary, counts binary")
    return asked.groupBy("part").applyInArrow(sums, "gram long, count long")


def scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, least: int = LEAST_COUNT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_backoff, log_score), one for each row of ``docs``, under the model of all of ``docs``.

    Words are runs of characters other than ASCII white space, unchanged. A word scores
    log(count of its n-gram / count of the context) for the longest n-gram that occurs
    ``least`` times or more, with log(``backoff``) for each step down; single words score
    log(count / number of words) and need no least count. The first words of a text have
    shorter contexts at no charge. Null and empty texts have no words and score 0. Rows
    that repeat are scored and counted each. Other columns are not read.
    """
    chunked, parts = _chunked(docs, id_col, text_col)
    asked = chunked.groupBy("chunk").applyInArrow(_request(order, parts), "chunk int, part int, grams binary, counts binary")
    replies = asked.groupBy("part").applyInArrow(_reply, "chunk int, part int, totals binary")
    return chunked.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(_score(order, backoff, least), "doc_id long, n_words long, n_backoff long, log_score double")
