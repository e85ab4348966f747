"""Best-fit packing of token sequences with a bounded number of open bins.

Pieces are dealt to packing groups whose number grows with the token count. Each
group is packed online: a fixed number of bins is open, kept in a bit set keyed by
free space; a piece goes to the bin that it leaves fullest; when none fits and all
bins are in use, the fullest one closes first.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from keelsort.llm.bpe import piece_lengths
from keelsort.llm.common import plain_names, settle, tidied

#: Tokens that one packing group takes on; more groups leave more bins partly filled.
GROUP_TOKENS = 40_000_000
OPEN_BINS = 1024


class Packer:
    """Bounded-space best fit into bins of ``capacity``.

    ``put(length)`` returns (bin number, offset). Bit f of ``free`` is set while some
    open bin has f tokens left. Lengths must be within 1..capacity.
    """

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        if capacity < 1 or open_bins < 1:
            raise ValueError("capacity and open_bins must be positive")
        self.capacity, self.most = capacity, open_bins
        self.free = 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = 0
        self.made = 0

    def put(self, length: int) -> tuple[int, int]:
        if not 1 <= length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens does not fit")
        fits = self.free >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            stack = self.bins[room]
            at = stack.pop()
            if not stack:
                self.free &= ~(1 << room)
        else:
            if self.open == self.most:
                # the fullest bin has the least free space
                least = (self.free & -self.free).bit_length() - 1
                self.bins[least].pop()
                if not self.bins[least]:
                    self.free &= ~(1 << least)
                self.open -= 1
            room, at = self.capacity, self.made
            self.made += 1
            self.open += 1
        rest = room - length
        if rest:
            self.bins[rest].append(at)
            self.free |= 1 << rest
        else:
            self.open -= 1
        return at, self.capacity - room


def pack_pieces(pieces: DataFrame, capacity: int, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Add sequence_id and offset to rows with doc_id, piece and length (1..capacity).

    Groups get pieces by a hash of doc_id and piece. Within a group pieces are taken by
    a hash of their key, so that long and short ones mix; ties go by doc_id and piece.
    An empty input gives an empty result; rows of equal doc_id and piece are packed
    each; other columns are kept, whatever their names. The only figure that comes to the driver is the sum of lengths.
    """
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, math.ceil(total / group_tokens))
    plain, _ = plain_names(pieces)
    names = plain.columns
    doc_id, piece, length = (names[pieces.columns.index(c)] for c in ("doc_id", "piece", "length"))
    dealt = (
        plain.withColumn("group", F.pmod(F.xxhash64(doc_id, piece), F.lit(groups)).cast("int"))
        .withColumn("turn", F.xxhash64(piece, doc_id, F.lit(17)))
        .repartition(groups, "group")
        .sortWithinPartitions("group", "turn", doc_id, piece)
    )

    def run(batches):
        packer, group = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = batch.column(batch.schema.get_field_index("group")).to_pylist()
            lengths = batch.column(batch.schema.get_field_index(length)).to_pylist()
            seq, off = np.empty(len(own), np.int64), np.empty(len(own), np.int64)
            for i, (g, n) in enumerate(zip(own, lengths)):
                if g != group:
                    packer, group = Packer(capacity, open_bins), g
                at, where = packer.put(n)
                seq[i], off[i] = (g << 40) + at, where
            kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"{name} {f.dataType.simpleString()}" for name, f in zip(names, pieces.schema.fields))
    return dealt.mapInArrow(tidied(run), f"{fields}, sequence_id long, offset long").toDF(*pieces.columns, "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocab_path: str, capacity: int = 4096, end_id: int = 1, open_bins: int = OPEN_BINS, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Pack each text's ids and a closing ``end_id``; only longer ones are cut.

    Null text counts as empty (one token, the closing one). Returns doc_id, piece,
    start, length, ids_crc32, sequence_id, offset; no other column is read. The token
    lengths are written to the shared folder once and packed from there.
    """
    return pack_pieces(settle(piece_lengths(docs, vocab_path, capacity, end_id)), capacity, open_bins, group_tokens)
