"""BPE encoding and decoding by a pair occurrence index.

The distinct pre-tokens of a batch lie one after the other in flat symbol arrays.
An index maps each mergeable pair's rank to all its positions in the batch; the
active ranks are applied once, in ascending order, each to all its positions, and
the position lists of the pairs that a merge creates are extended.  One ascending
pass is exact because a merge only creates pairs of higher rank, which `Vocabulary`
verifies for its file.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from keelsort.llm.common import slices, texts_of, tidied, words_of

#: Text bytes whose distinct words are encoded together; bounds a task's memory.
BATCH_BYTES = 8_000_000
#: Pre-token pattern of the word-end vocabulary, for ASCII and Latin text (an exact subset of its rule).
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: Characters that the fast path takes as they are: ASCII (no control characters) and Latin letters with one-to-one lower case, all of them stable under NFC.
PLAIN = "^[!-~ªµºÀ-ÖØ-öø-ÿ]+$"
LETTERS = "a-zªµºß-öø-ÿ"
PIECES = re.compile("\n|" + "|".join(CONTRACTIONS) + f"|[{LETTERS}]+|[0-9]|[^\n{LETTERS}0-9]+")
SPECIAL_START = "<|"


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(other)) for b in range(256)]


class Vocabulary:
    """A byte-level BPE file with word ends (`</w>`), lower case, white space dropped.

    Raises ValueError for a file with other rules, as its results would be wrong.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or model.get("end_of_word_suffix") != "</w>" or kinds != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None:
            raise ValueError("only byte-level BPE files with word ends, lower case and no decoder are supported")
        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        ids: dict[str, int] = model["vocab"]
        self.size = max(ids.values()) + 1 + len(spec["added_tokens"])
        self.token = [""] * self.size
        for k, v in ids.items():
            self.token[v] = k
        for x in spec["added_tokens"]:
            self.token[x["id"]] = x["content"]
        self.special = [x["content"] for x in spec["added_tokens"]]
        symbols = byte_symbols()
        self.inner = np.array([ids[s] for s in symbols], dtype=np.int32)
        self.final = np.array([ids[s + "</w>"] for s in symbols], dtype=np.int32)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.left = np.array([ids[a] for a, b in pairs], dtype=np.int64)
        self.right = np.array([ids[b] for a, b in pairs], dtype=np.int64)
        self.made = np.array([ids[a + b] for a, b in pairs], dtype=np.int32)
        born = np.full(self.size, -1, dtype=np.int64)
        if len(set(self.made.tolist())) != len(pairs):
            raise ValueError("a token is made by more than one merge")
        born[self.made] = np.arange(len(pairs))
        if (np.maximum(born[self.left], born[self.right]) >= np.arange(len(pairs))).any():
            raise ValueError("a merge uses a token that a later merge makes")
        keys = self.left * self.size + self.right
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.rank_of = {int(k): int(r) for k, r in zip(self.keys, self.ranks)}

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        want = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, want)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == want, self.ranks[at], -1)

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encode byte strings laid end to end in ``data`` (``ends``: exclusive ends): token ids and their ends."""
        n = len(data)
        if n == 0:
            return np.zeros(0, np.int32), np.zeros(len(ends), np.int64)
        sym = self.inner[data]
        sym[ends - 1] = self.final[data[ends - 1]]
        nxt = np.arange(1, n + 1, dtype=np.int32)
        prv = np.arange(-1, n - 1, dtype=np.int32)
        nxt[ends - 1] = -1
        starts = np.concatenate([[0], ends[:-1]])
        prv[starts] = -1
        live = np.flatnonzero(nxt >= 0).astype(np.int32)
        ranks = self.rank(sym[live], sym[live + 1])
        ok = ranks >= 0
        live, ranks = live[ok], ranks[ok]
        order = np.argsort(ranks, kind="stable")
        live, ranks = live[order], ranks[order]
        # the index: rank -> positions; lists grow as merges create pairs
        index: list[list | None] = [None] * len(self.made)
        cut = np.flatnonzero(np.diff(ranks)) + 1
        first = np.concatenate([[0], cut]) if len(ranks) else []
        for i, part in zip(ranks[first].tolist() if len(ranks) else [], np.split(live, cut) if len(ranks) else []):
            index[i] = [part]
        get = self.rank_of.get
        left, right, made = self.left.tolist(), self.right.tolist(), self.made.tolist()
        size = self.size
        for r in range(len(index)):
            lists = index[r]
            if lists is None:
                continue
            index[r] = None
            a, b, c = left[r], right[r], made[r]
            p = lists[0] if len(lists) == 1 else np.concatenate(lists)
            if len(p) > 12:
                p = p[sym[p] == a]
                q = nxt[p]
                ok = q >= 0
                ok &= sym[q] == b
                p, q = p[ok], q[ok]
                if len(lists) > 1:
                    p = np.unique(p)
                    q = nxt[p]
                if a == b and len(p) > 1:
                    p = _leftmost(p, q)
                    q = nxt[p]
                if not len(p):
                    continue
                after = nxt[q]
                sym[p] = c
                sym[q] = -1
                nxt[p] = after
                has = after >= 0
                prv[after[has]] = p[has]
                before = prv[p]
                for pos, x, y in ((before[before >= 0], None, None), (p[nxt[p] >= 0], None, None)):
                    if not len(pos):
                        continue
                    new = self.rank(sym[pos], sym[nxt[pos]])
                    ok = new >= 0
                    if not ok.any():
                        continue
                    pos, new = pos[ok], new[ok]
                    order = np.argsort(new, kind="stable")
                    pos, new = pos[order], new[order]
                    cut = np.flatnonzero(np.diff(new)) + 1
                    for k, part in zip(new[np.concatenate([[0], cut])].tolist(), np.split(pos, cut)):
                        if index[k] is None:
                            index[k] = [part]
                        else:
                            index[k].append(part)
            else:
                for i in sorted(p.tolist()):
                    if sym[i] != a:
                        continue
                    j = int(nxt[i])
                    if j < 0 or sym[j] != b:
                        continue
                    k = int(nxt[j])
                    sym[i] = c
                    sym[j] = -1
                    nxt[i] = k
                    h = int(prv[i])
                    if k >= 0:
                        prv[k] = i
                        x = get(c * size + int(sym[k]))
                        if x is not None:
                            one = np.array([i], dtype=np.int32)
                            if index[x] is None:
                                index[x] = [one]
                            else:
                                index[x].append(one)
                    if h >= 0:
                        x = get(int(sym[h]) * size + c)
                        if x is not None:
                            one = np.array([h], dtype=np.int32)
                            if index[x] is None:
                                index[x] = [one]
                            else:
                                index[x].append(one)
        kept = sym >= 0
        before = np.cumsum(kept)
        return sym[kept], before[ends - 1]


def _leftmost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of overlapping occurrences of a pair of equal symbols, those a left-to-right scan takes."""
    taken, last = [], -1
    for i, j in zip(p.tolist(), q.tolist()):
        if i != last:
            taken.append(i)
            last = j
    return np.array(taken, dtype=np.int32)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def _coded(values: pa.Array) -> pa.DictionaryArray:
    coded = values.dictionary_encode()
    return coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded


class Encoded:
    """Token ids of a batch of texts: `ids[ends[i-1]:ends[i]]` are those of text i."""

    __slots__ = ("chunks", "chunk_offsets", "table_ids", "table_ends", "lengths", "ends")

    def __init__(self, chunks, chunk_offsets, table_ids, table_ends):
        self.chunks, self.chunk_offsets = chunks, chunk_offsets
        self.table_ids, self.table_ends = table_ids, table_ends
        self.lengths = np.diff(np.concatenate([[0], table_ends]))
        total = np.concatenate([[0], np.cumsum(self.lengths[chunks])])
        self.ends = total[chunk_offsets[1:]]

    def flat(self) -> np.ndarray:
        """All ids of the batch in order."""
        n = self.lengths[self.chunks]
        total = int(n.sum())
        if not total:
            return np.zeros(0, np.int32)
        starts = (self.table_ends - self.lengths)[self.chunks]
        into = np.cumsum(n) - n
        at = np.arange(total, dtype=np.int64)
        at += np.repeat(starts - into, n)
        return self.table_ids[at]


def encode(vocab: Vocabulary, texts: pa.Array) -> Encoded:
    """Encode whole texts; a text's ids are those of its white-space separated chunks in a row.

    No token spans white space, so each distinct chunk is encoded once. Chunks with
    characters outside the plain set, or with a special token's string, go through
    the tokenizer library itself.
    """
    flat, offsets = words_of(texts)
    if len(flat) == 0:
        return Encoded(np.zeros(0, np.int64), offsets, np.zeros(0, np.int32), np.zeros(0, np.int64))
    coded = _coded(flat)
    codes = np.asarray(coded.indices).astype(np.int64)
    distinct = coded.dictionary
    fast = pc.match_substring_regex(distinct, PLAIN)
    if vocab.special:
        fast = pc.and_(fast, pc.invert(pc.match_substring(distinct, SPECIAL_START)))
    is_fast = np.asarray(fast)
    odd = {i: vocab.exact.encode(distinct[i].as_py(), add_special_tokens=False).ids for i in np.flatnonzero(~is_fast).tolist()}
    low = pc.utf8_lower(distinct)
    single = np.asarray(pc.ascii_is_alpha(low)) & is_fast
    n_pieces = single.astype(np.int64)
    mixed = np.flatnonzero(is_fast & ~single)
    # one pass over all chunks with other characters than letters; line feeds mark their ends
    found = PIECES.findall("".join([f"{x}\n" for x in low.take(pa.array(mixed)).to_pylist()]))
    found = pa.array(found, pa.large_string())
    ends_at = np.flatnonzero(np.asarray(pc.equal(found, "\n"))) if len(found) else np.zeros(0, np.int64)
    n_pieces[mixed] = np.diff(np.concatenate([[-1], ends_at])) - 1
    found = found.filter(pc.not_equal(found, "\n")) if len(found) else found
    pieces = _coded(pa.concat_arrays([low.filter(pa.array(single)), found]))
    number = np.asarray(pieces.indices).astype(np.int64)
    # pieces in the order of their chunks
    owner = np.repeat(np.arange(len(distinct)), n_pieces)
    seq = np.empty(len(owner), dtype=np.int64)
    of_single = single[owner] if len(owner) else np.zeros(0, bool)
    n_single = int(single.sum())
    seq[of_single] = number[:n_single]
    seq[~of_single] = number[n_single:]
    offsets_of = np.frombuffer(pieces.dictionary.buffers()[1], dtype=np.int64)[pieces.dictionary.offset : pieces.dictionary.offset + len(pieces.dictionary) + 1]
    if len(pieces.dictionary):
        data = np.frombuffer(pieces.dictionary.buffers()[2], dtype=np.uint8)[offsets_of[0] : offsets_of[-1]]
        ids, id_ends = vocab.merge(data, offsets_of[1:] - offsets_of[0])
    else:
        ids, id_ends = np.zeros(0, np.int32), np.zeros(0, np.int64)
    # from pieces to chunks
    per_piece = np.diff(np.concatenate([[0], id_ends]))
    n = per_piece[seq] if len(seq) else np.zeros(0, np.int64)
    starts = (id_ends - per_piece)[seq] if len(seq) else n
    total = int(n.sum())
    at = np.arange(total, dtype=np.int64) + np.repeat(starts - (np.cumsum(n) - n), n)
    table_ids = ids[at] if total else np.zeros(0, np.int32)
    piece_ends = np.concatenate([[0], np.cumsum(n)])
    table_ends = piece_ends[np.cumsum(n_pieces)]
    if odd:
        lengths = np.diff(np.concatenate([[0], table_ends]))
        shift = np.zeros(len(distinct), dtype=np.int64)
        for i, x in odd.items():
            shift[i] = len(x)
        new_ends = np.cumsum(lengths + shift)
        out = np.empty(int(new_ends[-1]), dtype=np.int32)
        is_old = np.ones(len(out), dtype=bool)
        for i, x in odd.items():
            s = int(new_ends[i]) - len(x)
            out[s : s + len(x)] = x
            is_old[s : s + len(x)] = False
        out[is_old] = table_ids
        table_ids, table_ends = out, new_ends
    return Encoded(codes, offsets, table_ids, table_ends)


def decode(vocab: Vocabulary, ids: list[int]) -> str:
    """Text of ids as a tokenizer without decoder gives it: the tokens joined by one space."""
    token = vocab.token
    return " ".join([token[i] for i in ids])


_SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])


def encode_documents(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, ids array<int>, decoded string) of every whole text.

    Null text counts as empty and gives no ids; other columns are not read. Repeated
    rows each give a row; an empty table gives no rows.
    """

    def run(batches):
        vocab = vocabulary(vocab_path)
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                enc = encode(vocab, texts_of(part, "text"))
                flat = enc.flat()
                bounds = np.concatenate([[0], enc.ends]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32()))
                listed = flat.tolist()
                b = bounds.tolist()
                text = [decode(vocab, listed[s:e]) for s, e in zip(b, b[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array(text, pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), _SCHEMA)


def encoding_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """As `encode_documents`, but digests of the ids and the decoded text in place of both: n_tokens, ids_sha256, decoded_sha256."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        number = [str(i) for i in range(vocab.size)]
        token = vocab.token
        sha = hashlib.sha256
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                enc = encode(vocab, texts_of(part, "text"))
                # the strings of each distinct chunk are made once; a text joins those of its chunks
                ids, ends = enc.table_ids.tolist(), np.concatenate([[0], enc.table_ends]).tolist()
                spans = list(zip(ends, ends[1:]))
                as_ids = [" ".join([number[i] for i in ids[s:e]]) for s, e in spans]
                as_text = [" ".join([token[i] for i in ids[s:e]]) for s, e in spans]
                hollow = bool((enc.lengths == 0).any())
                chunks, bounds = enc.chunks.tolist(), enc.chunk_offsets.tolist()
                a, b = [], []
                for s, e in zip(bounds, bounds[1:]):
                    own = chunks[s:e]
                    x, y = [as_ids[i] for i in own], [as_text[i] for i in own]
                    if hollow:
                        x, y = [v for v in x if v], [v for v in y if v]
                    a.append(sha(" ".join(x).encode()).hexdigest())
                    b.append(sha(" ".join(y).encode()).hexdigest())
                n = np.diff(np.concatenate([[0], enc.ends])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def piece_lengths(docs: DataFrame, vocab_path: str, capacity: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens of each text's ids and a closing ``end_id``: doc_id, piece, start, length, ids_crc32."""

    def run(batches):
        vocab = vocabulary(vocab_path)
        crc = zlib.crc32
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                enc = encode(vocab, texts_of(part, "text"))
                raw = enc.flat().astype("<u4").tobytes()
                bounds = np.concatenate([[0], enc.ends]).tolist()
                close = int(end_id).to_bytes(4, "little")
                rows = ([], [], [], [], [])
                for doc, s, e in zip(part.column(0).to_pylist(), bounds, bounds[1:]):
                    size = e - s + 1
                    if size <= capacity:
                        for r, v in zip(rows, (doc, 0, 0, size, crc(close, crc(raw[4 * s : 4 * e])))):
                            r.append(v)
                        continue
                    own = raw[4 * s : 4 * e] + close
                    for k, at in enumerate(range(0, size, capacity)):
                        for r, v in zip(rows, (doc, k, at, min(capacity, size - at), crc(own[4 * at : 4 * (at + capacity)]))):
                            r.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidied(run), "doc_id long, piece int, start long, length long, ids_crc32 long")
