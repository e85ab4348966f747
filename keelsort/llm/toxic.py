"""Toxicity scores from subword-bag embeddings averaged into a linear softmax.

A word's vector is the mean of the vectors of its character n-grams (hashed to a
fixed number of buckets) and of the word itself; a text's vector is the mean over
its distinct words. Embeddings and softmax are trained jointly in numpy by Adam.
A misspelling that was never seen shares most n-grams with the word it stands for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keelsort.llm.common import _M1, slices, texts_of, tidied, tidy, words_of

BUCKETS = 1 << 17
GRAMS = (3, 4, 5)
#: Bound of the sample of labelled rows that the model is fit on; a documented parameter.
MAX_TRAINING_ROWS = 6_000
DIM = 4
#: A bucket gets a vector that is in so many labelled texts and whose share of label 1 is so many standard errors off; weight decay of the fit.
MIN_DOCS, LEAST_Z, DECAY = 4, 5.5, 1e-6
BATCH_BYTES = 4_000_000
#: Distinct words of the fit whose n-grams are made at once.
WORDS_AT_ONCE = 20_000
_P = np.uint32(0x01000193)


def subwords(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the n-grams of each word (with boundary marks) laid end to end, and each word's count."""
    marked = pc.binary_join_element_wise(pa.scalar("<", pa.large_string()), words.cast(pa.large_string()), pa.scalar(">", pa.large_string()), pa.scalar("", pa.large_string()))
    buffers = marked.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[marked.offset : marked.offset + len(marked) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0] : offsets[-1]].astype(np.uint32)
    offsets = offsets - offsets[0]
    n = len(data)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), np.diff(offsets))
    left = offsets[1:][owner] - np.arange(n)  # bytes from here to the word's end
    h = np.full(n, 0x811C9DC5, dtype=np.uint32)
    found, owners = [], []
    for k in range(1, max(GRAMS) + 1):
        h[: n - k + 1] = (h[: n - k + 1] ^ data[k - 1 :]) * _P
        if k in GRAMS:
            ok = left >= k
            found.append((h[ok] ^ (h[ok] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + np.uint32(k))
            owners.append(owner[ok])
    # the whole word: a sum of its bytes' powers, position by position
    place = np.arange(n) - offsets[:-1][owner]
    power = (np.uint64(0x9E3779B97F4A7C15) * (place.astype(np.uint64) * np.uint64(2) + np.uint64(1))) ^ (data.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    power = (power ^ (power >> np.uint64(29))) * _M1
    whole = np.add.reduceat(power, offsets[:-1]) if len(words) else np.zeros(0, np.uint64)
    found.append(((whole >> np.uint64(32)) ^ whole).astype(np.uint32))
    owners.append(np.arange(len(words), dtype=np.int64))
    ids = np.concatenate(found) & np.uint32(BUCKETS - 1)
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return ids[order].astype(np.int32), np.bincount(owners, minlength=len(words))


def bags(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words of all texts (lower case, without other characters at their ends), and each text's distinct word numbers with ends."""
    flat, offsets = words_of(texts)
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    bare = pc.utf8_trim(pc.utf8_lower(coded.dictionary), "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789")
    again = bare.dictionary_encode()
    if isinstance(again, pa.ChunkedArray):
        again = again.combine_chunks()
    number = np.asarray(again.indices).astype(np.int64)[np.asarray(coded.indices).astype(np.int64)] if len(flat) else np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(offsets))
    width = max(1, len(again.dictionary))
    key = np.unique(doc * width + number)
    return again.dictionary, (key % width), np.searchsorted(key // width, np.arange(1, len(texts) + 1))


def packed_bags(texts: pa.Array) -> list[str]:
    """Each text's distinct words in order, with a line feed before each: words have none."""
    words, of_doc, ends = bags(texts)
    names, begin, out = words.to_pylist(), 0, []
    for end in ends.tolist():
        out.append("".join("\n" + w for w in sorted(names[k] for k in of_doc[begin:end])))
        begin = end
    return out


def unpacked_bags(packed: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What `bags` gives, from `packed_bags` of all texts."""
    lists = pc.split_pattern(pa.array(packed, pa.large_string()), "\n")
    flat, offsets = pc.list_flatten(lists), np.asarray(lists.offsets, dtype=np.int64)
    keep = np.ones(len(flat), dtype=bool)
    keep[offsets[:-1]] = False  # what is before the first line feed
    coded = flat.filter(pa.array(keep)).dictionary_encode()
    return coded.dictionary, np.asarray(coded.indices).astype(np.int64), np.cumsum(np.diff(offsets) - 1)


def _runs(groups: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Positions of all members of each listed group, where group g has counts[g] members laid end to end."""
    n = counts[groups]
    first = firsts[groups]
    return np.arange(int(n.sum())) + np.repeat(first - (np.cumsum(n) - n), n)


def train(texts: list[str], labels: np.ndarray, dim: int = DIM, rounds: int = 60, rate: float = 0.1, seed: int = 7, min_docs: int = MIN_DOCS, decay: float = DECAY, packed: bool = False) -> tuple[np.ndarray, float]:
    """Fit and fold the model to one weight for each bucket and a bias: the logit is the mean over words of the mean weight of their buckets.

    ``packed`` tells that the texts are `packed_bags` of texts. With no texts, or labels of one kind only, the weights are zero and the bias gives the share of that label.
    """
    share = (float(np.sum(labels)) + 0.5) / (len(labels) + 1.0)
    bias = float(np.log(share / (1 - share)))
    if not len(texts) or len(set(np.asarray(labels).tolist())) < 2:
        return np.zeros(BUCKETS, np.float32), bias
    words, of_doc, doc_ends = unpacked_bags(texts) if packed else bags(pa.array(texts, pa.large_string()))
    del texts
    # slice by slice: the n-grams of all words at once would be the driver's peak
    parts = [subwords(words.slice(at, WORDS_AT_ONCE)) for at in range(0, len(words), WORDS_AT_ONCE)] or [subwords(words)]
    ids, per_word = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    del parts
    word_of = np.repeat(np.arange(len(words), dtype=np.int32), per_word)
    per_doc = np.diff(np.concatenate([[0], doc_ends]))
    n_texts = len(per_doc)
    doc_of = np.repeat(np.arange(n_texts, dtype=np.int32), per_doc)
    # only buckets tied to the label by a test of independence get a vector: others would learn texts by heart
    y1 = np.asarray(labels, dtype=np.int64)
    n, n1 = np.zeros(BUCKETS), np.zeros(BUCKETS)
    firsts = np.cumsum(per_word) - per_word
    begin = 0
    for end, label in zip(doc_ends.tolist(), y1.tolist()):
        own = np.unique(ids[_runs(of_doc[begin:end], per_word, firsts)])
        n[own] += 1
        if label:
            n1[own] += 1
        begin = end
    rate1 = y1.mean()
    z = (n1 - n * rate1) / np.sqrt(n * rate1 * (1 - rate1) * (1 - n / (len(y1) + 1)) + 1e-9)
    telling = (np.abs(z) >= LEAST_Z) & (n >= min_docs)
    kept = telling[ids]
    ids, word_of = ids[kept], word_of[kept]
    if not len(ids):
        return np.zeros(BUCKETS, np.float32), bias
    used, ids = np.unique(ids, return_inverse=True)
    w_scale, d_scale = 1.0 / np.maximum(per_word, 1), 1.0 / np.maximum(per_doc, 1)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (len(used), dim))
    soft = rng.normal(0, 0.3, (dim, 2))
    b = np.array([0.0, bias])
    y = np.zeros((n_texts, 2))
    y[np.arange(n_texts), np.asarray(labels, dtype=int)] = 1
    moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (emb, soft, b)]
    weight = 1.0 / n_texts
    for t in range(1, rounds + 1):
        vec = np.empty((len(words), dim))
        for k in range(dim):
            vec[:, k] = np.bincount(word_of, emb[ids, k], len(words)) * w_scale
        bag = np.empty((n_texts, dim))
        for k in range(dim):
            bag[:, k] = np.bincount(doc_of, vec[of_doc, k], n_texts) * d_scale
        bag *= SCALE
        z = bag @ soft + b
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        dz = (p - y) * weight
        d_soft, d_b = bag.T @ dz, dz.sum(axis=0)
        d_bag = (dz @ soft.T) * (d_scale[:, None] * SCALE)
        d_emb = np.empty_like(emb)
        for k in range(dim):
            d_vec = np.bincount(of_doc, d_bag[doc_of, k], len(words)) * w_scale
            d_emb[:, k] = np.bincount(ids, d_vec[word_of], len(used))
        for (m, v), p_, g in zip(moments, (emb, soft, b), (d_emb + decay * emb, d_soft + decay * soft, d_b)):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            p_ -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-10)
    weights = np.zeros(BUCKETS, np.float32)
    weights[used] = (emb @ (soft[:, 1] - soft[:, 0])) * SCALE
    return weights, float(b[1] - b[0])


#: Scale of a text's mean vector before the softmax, so that a few words out of hundreds can carry it.
SCALE = 200.0


def logits(texts: pa.Array, weights: np.ndarray, bias: float) -> np.ndarray:
    """Logit of each text; a text without words has the bias."""
    words, of_doc, doc_ends = bags(texts)
    if not len(words):
        return np.full(len(texts), bias)
    ids, per_word = subwords(words)
    owner = np.repeat(np.arange(len(words)), per_word)
    score = np.bincount(owner, weights[ids], len(words)) / np.maximum(per_word, 1)
    per_doc = np.diff(np.concatenate([[0], doc_ends]))
    doc = np.repeat(np.arange(len(texts)), per_doc)
    return np.bincount(doc, score[of_doc], len(texts)) / np.maximum(per_doc, 1) + bias


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, float]:
    """Fit on at most ``max_rows`` labelled rows whose crc32(id as text) mod 5 is not 0.

    The rows are those of smallest hash, whatever the input's size; of them
    only the distinct words of each whole text come to the driver, made in tasks. Rows with a null id or label take no
    part; an identifier with several labels counts as its largest, one with several
    texts as one of them.
    """
    chosen = (
        labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_rows)
    )
    rows = chosen.collect()
    if not rows:
        return train([], np.zeros(0, int))
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, label int")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # max_rows rows of two numbers: a broadcast of bounded size
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed_bags(texts_of(part, "text")), pa.string())], names=["doc_id", "label", "bag"])

    bagged = own.join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text").mapInArrow(tidied(run), "doc_id long, label int, bag string")
    # of rows that repeat an identifier the one of the smallest bag: as many rows as identifiers
    got = sorted(bagged.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("bag").alias("bag")).collect(), key=lambda r: r["doc_id"])
    own = np.array([r["label"] for r in got], dtype=int)
    model = train([r["bag"] for r in got], own, packed=True)
    del got
    tidy()
    return model


def scores(docs: DataFrame, model: tuple[np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, score) of every whole text, score within 0..1; null text counts as empty and has the model's base rate.

    Rows that repeat are scored each, those of a null identifier too; an empty table
    gives an empty result.

    The model is one array of fixed size, sent with the function.
    """
    weights, bias = model

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                z = logits(texts_of(part, "text"), weights, bias)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))))], names=["doc_id", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score is below ``threshold``; no shuffle.

    Null and empty texts go by the model's base rate; repeated rows go or stay alike.
    """
    weights, bias = model
    schema, at = docs.schema, docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part in slices(named, f"c{at}", BATCH_BYTES):
                z = logits(texts_of(part, f"c{at}"), weights, bias)
                keep = 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60))) < threshold
                yield part.filter(pa.array(keep)).rename_columns(batch.schema.names)

    return docs.mapInArrow(tidied(run), schema)
