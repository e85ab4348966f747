"""MinHash near-dedup by a chosen-path set similarity join.

Texts branch down random trees: a node chooses coordinates of the MinHash signature by
a hash of its path, and a text follows each of them to the child of its own value
there. Nodes of few texts are compared exhaustively on signatures, larger ones branch
on; several independent trees bring the recall to its target. What signatures cannot
rule out is confirmed on full sets.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from keelsort.llm.common import components, grouped, mix, plain_names, semi_by_filter, settle, slices, texts_of, tidied, without, word_hashes, words_of

COORDINATES = 128
#: A node of the first LEVELS follows one coordinate, and every fourth one two: 1 / 0.8 on average. Deeper ones all follow two, so that a
#: pair's chance does not fall with the depth: at 0.8 a tree keeps it with probability 0.73 at two levels, 0.70 at four and 0.695 at ten,
#: one of TREES with 0.99997, 0.99993 and 0.99992, if trees are independent.
BRANCHES, LEVELS, DEEPEST, TREES = 2, 2, 10, 8
#: A large node is dense where so large a share of it is like one of its centres: branching would not take it apart.
DENSE = 0.5
#: Texts in a node that is compared exhaustively, and in a block of a confirming task.
NODE_LIMIT, BLOCK = 1024, 200
#: Centres that a large node is held against, and rows of 256 bytes a centre up to which they are broadcast.
CENTRES, BROADCAST_NODES = 3, 8192
#: Text bytes that a task takes apart at once.
BATCH_BYTES = 3_000_000
_rng = np.random.default_rng(20260101)
_XOR = _rng.integers(0, 1 << 32, COORDINATES, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, COORDINATES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SALT = np.uint64(0x632BE59BD9B4E019)


def shingles(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text, sorted, laid end to end, and the offsets.

    A-Z are lower-cased; a text of fewer words has its whole sequence as one shingle.
    A shingle is a 64-bit hash of its words' 64-bit hashes.
    """
    flat, offsets = words_of(pc.ascii_lower(texts))
    n = np.diff(offsets)
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    h = word_hashes(flat)
    del flat
    run = h[: max(0, len(h) - size + 1)].copy()
    for k in range(1, size):
        run *= _STEP
        run += h[k : len(h) - size + 1 + k]
    full = n >= size
    count = np.where(full, n - size + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(starts[-1], np.uint64)
    # places whose shingle lies within one text, in order
    ends = np.zeros(len(h) + 1, dtype=np.int8)
    own = np.flatnonzero(full)
    np.add.at(ends, offsets[own], 1)
    np.add.at(ends, offsets[own + 1] - size + 1, -1)
    within = np.repeat(full, count)
    out[within] = run[np.flatnonzero(np.cumsum(ends[: len(run)], dtype=np.int8))] + np.uint64(size)
    del run, ends, within
    # shorter texts: one run of all their words
    for count_ in range(1, size):
        short = np.flatnonzero(n == count_)
        value = np.zeros(len(short), np.uint64)
        for k in range(count_):
            value = value * _STEP + h[offsets[short] + k]
        out[starts[short]] = value + np.uint64(count_)
    out = mix(out)
    for s, e in zip(starts.tolist(), starts[1:].tolist()):
        out[s:e].sort()
    new = np.ones(len(out), dtype=bool)
    new[1:] = out[1:] != out[:-1]
    new[starts[:-1][count > 0]] = True
    kept = np.concatenate([[0], np.cumsum(new)])
    return out[new], kept[starts]


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """MinHash signature of each set: COORDINATES values of 16 bits; all zero for an empty set."""
    n = len(offsets) - 1
    out = np.zeros((n, COORDINATES), dtype=np.uint16)
    low = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    at = 0
    while at < len(full):
        # blocks that stay in the processor's cache
        begin = offsets[full[at]]
        end = int(np.searchsorted(offsets[full[at:] + 1], begin + 32_768, side="right"))
        own = full[at : at + max(1, end)]
        at += len(own)
        x = low[begin : offsets[own[-1] + 1]]
        starts = offsets[own] - begin
        for k in range(COORDINATES):
            least = np.minimum.reduceat((x ^ _XOR[k]) * _MUL[k], starts)
            out[own, k] = ((least ^ (least >> np.uint32(16))) * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    return out


def _binary(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie end to end in ``values``, one up to each of ``ends`` (counted in values)."""
    at = np.concatenate([[0], ends * values.itemsize]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(at), pa.py_buffer(np.ascontiguousarray(values))])


def _set_rows(size: int):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                sets, offsets = shingles(texts_of(part, "text"), size)
                sig = signatures(sets, offsets)
                sums = []
                for salt in (np.uint64(0), _SALT):
                    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ salt), dtype=np.uint64)])
                    sums.append((total[offsets[1:]] - total[offsets[:-1]]).view(np.int64))
                raw = _binary(sig.reshape(-1), np.arange(1, len(sig) + 1) * COORDINATES)
                made = pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.diff(offsets)), pa.array(sums[0]), pa.array(sums[1]), raw], names=["doc_id", "mark", "n", "k1", "k2", "sig"])
                del sets, offsets, sig, sums, raw
                yield made
                del made

    return tidied(run)


def children(path: np.ndarray, sig: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Paths of the children that texts go to from ``path`` at ``level``, and each one's row."""
    paths, rows = [], []
    for j in range(BRANCHES):
        # all texts of a node branch alike: the choice hangs on the path alone, which starts from the tree
        pick = mix(path + np.uint64((1 + j + BRANCHES * level) * int(_STEP) & 0xFFFFFFFFFFFFFFFF))
        at = np.arange(len(path)) if j == 0 or level >= LEVELS else np.flatnonzero((pick >> np.uint64(40)) & np.uint64(3) == 0)
        c = (pick[at] % np.uint64(COORDINATES)).astype(np.int64)
        paths.append(mix(path[at] ^ mix((c.astype(np.uint64) << np.uint64(16)) + sig[at, c].astype(np.uint64) + np.uint64(1))))
        rows.append(at)
    return np.concatenate(paths), np.concatenate(rows)


def _signature_matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint16).reshape(-1, COORDINATES)


def _once(path: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Places of the distinct pairs: both branches of a text may have chosen one coordinate."""
    order = np.lexsort((path, rows))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (path[order[1:]] != path[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]])
    return order[new]


def _first_paths(trees: int):
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                sig = _signature_matrix(part.column(1))
                rep = np.asarray(part.column(0))
                for tree in range(trees):
                    path = np.full(len(rep), mix(np.array([tree + 1], np.uint64))[0])
                    own, who = path, np.arange(len(rep))
                    for level in range(LEVELS):
                        own, at_row = children(own, sig[who], level)
                        who = who[at_row]
                    kept = _once(own, who)
                    own, who = own[kept], who[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(rep[who])], names=["path", "rep"])

    return run


def _next_paths(level: int):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signature_matrix(batch.column(2))
            path = np.asarray(batch.column(0)).view(np.uint64)
            own, at_row = children(path, sig, level)
            kept = _once(own, at_row)
            own, at_row = own[kept], at_row[kept]
            # signatures travel with the rows of large nodes
            yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), batch.column(1).take(pa.array(at_row)), batch.column(2).take(pa.array(at_row))], names=["path", "rep", "sig"])

    return run


def _roots(n: int, pairs) -> list[int]:
    """Union-find over 0..n-1: the smallest member's position of each."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]


def _alike(least: float):
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signature_matrix(batch.column(1))
            near = [pa.array(((sig == _signature_matrix(batch.column(2 + k))).sum(axis=1) >= least * COORDINATES).astype(np.int32)) for k in range(CENTRES)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *near], names=["path", *[f"near{k}" for k in range(CENTRES)]])

    return run


def _compare(least: float):
    def alike(sig: np.ndarray, other: np.ndarray) -> np.ndarray:
        return (sig[:, None, :] == other[None, :, :]).sum(axis=2) >= least * COORDINATES

    def run(batches):
        for _, node in grouped(batches, "path"):
            rep = np.asarray(node.column("rep"))
            rep, first = np.unique(rep, return_index=True)
            sig = _signature_matrix(node.column("sig"))[first]
            pairs = []
            for i in range(0, len(rep), 128):
                for j in range(i, len(rep), 128):
                    x, y = np.nonzero(alike(sig[i : i + 128], sig[j : j + 128]))
                    x, y = x + i, y + j
                    ok = x < y
                    # one link a text and block is enough to join it to the group
                    x, y = x[ok], y[ok]
                    pairs += zip(x.tolist(), y.tolist())
            root = np.array(_roots(len(rep), pairs))
            moved = np.flatnonzero(root != np.arange(len(rep)))
            if len(moved):
                yield pa.RecordBatch.from_arrays([pa.array(rep[moved]), pa.array(rep[root[moved]])], names=["src", "dst"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = _common(a, b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def _confirm_star(percent: int):
    def run(batches):
        for batch in batches:
            ids, centres = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            src, dst = [], []
            for rep, centre, own, head in zip(ids, centres, batch.column(2), batch.column(3)):
                if _similar(np.frombuffer(own.as_buffer(), np.uint64), np.frombuffer(head.as_buffer(), np.uint64), percent):
                    src.append(rep)
                    dst.append(centre)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], names=["src", "dst"])

    return run


def _confirm(percent: int):
    def run(batches):
        for _, group in grouped(batches, "task"):
            ids = np.asarray(group.column("rep"))
            ids, first = np.unique(ids, return_index=True)
            own = group.column("shingles").take(pa.array(first)).combine_chunks()
            sets = [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in own]
            tied = np.asarray(group.column("tied"))[first]
            order = sorted(range(len(ids)), key=lambda i: len(sets[i]))
            # texts that are linked with their component's centre are one from the start
            up = list(range(len(ids)))
            centre = np.flatnonzero(tied).tolist()
            for i in centre[1:]:
                up[i] = centre[0]

            def find(x):
                while up[x] != x:
                    up[x] = up[up[x]]
                    x = up[x]
                return x

            links = []
            for at, i in enumerate(order):
                for j in order[at + 1 :]:
                    if 100 * len(sets[i]) < percent * len(sets[j]):
                        break  # all others are larger still
                    a, b = find(i), find(j)
                    if a != b and _similar(sets[i], sets[j], percent):
                        up[max(a, b)] = min(a, b)
                        links.append((ids[i], ids[j]))
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], names=["src", "dst"])

    return run


def _dense(crowd: DataFrame, alone: DataFrame, least: float) -> DataFrame:
    """Rows (path, dst) of the nodes ``alone(path, centres)`` of which a share of DENSE or more is like the centre ``dst``."""
    held = crowd.join(alone.select("path", "centres"), "path").where(F.array_contains("centres", F.col("rep")))
    heads = [F.max(F.when(F.col("rep") == F.col("centres")[k], F.col("sig"))).alias(f"h{k}") for k in range(CENTRES)]
    heads = settle(held.groupBy("path").agg(*heads, F.first("centres").alias("centres")))
    few = heads.count() <= BROADCAST_NODES
    asked = crowd.join(F.broadcast(heads) if few else heads, "path").select("path", "sig", *[f"h{k}" for k in range(CENTRES)])
    near = asked.mapInArrow(_alike(least), "path long, " + ", ".join(f"near{k} int" for k in range(CENTRES)))
    share = near.groupBy("path").agg(*[F.avg(f"near{k}").alias(f"s{k}") for k in range(CENTRES)])
    best = F.greatest(*[F.struct(F.col(f"s{k}").alias("share"), F.col("centres")[k].alias("dst")) for k in range(CENTRES)])
    return settle(share.join(heads.select("path", "centres"), "path").select("path", best.alias("best")).where(F.col("best.share") >= DENSE).select("path", "best.dst"))


def _coarse_links(reps: DataFrame, least: float, trees: int) -> DataFrame:
    """Links (src, dst) that join all texts of ``reps(rep, sig)`` which signatures cannot tell apart, by trees of chosen paths."""

    def signed(rows: DataFrame) -> DataFrame:
        """``rows(path, rep)`` with their signatures; only texts in question are sent."""
        rows = settle(rows)
        return rows.join(semi_by_filter(reps.select("rep", "sig"), rows.select("rep").distinct(), "rep"), "rep").select("path", "rep", "sig")

    level, open_ = LEVELS, reps.select("rep", "sig").mapInArrow(_first_paths(trees), "path long, rep long")
    small, stars = [], []
    first, last = F.min(F.struct(F.xxhash64("rep", "path"), "rep")), F.max(F.struct(F.xxhash64("rep", "path"), "rep"))
    while True:
        open_ = settle(open_)
        # a path that one text alone follows ends here, before its row meets others
        shared = settle(open_.groupBy("path").agg(F.count(F.lit(1)).alias("m")).where("m > 1"))
        held = settle(semi_by_filter(open_, shared, "path").join(shared, "path"))
        # nodes: members and two sums that tell their member sets apart
        nodes = settle(held.groupBy("path").agg(
            F.first("m").alias("m"), F.expr("bit_xor(xxhash64(rep))").alias("s1"), F.expr("bit_xor(xxhash64(rep, 9))").alias("s2"),
            F.array(first["rep"], last["rep"], F.min("rep")).alias("centres"),
        ))
        chosen = nodes.where(F.col("m") <= NODE_LIMIT).groupBy("s1", "s2", "m").agg(F.min("path").alias("path")).select("path")
        small.append(held.drop("m").join(chosen, "path"))
        large = nodes.where(F.col("m") > NODE_LIMIT).drop("m")
        if not large.limit(1).count():
            break
        # of large nodes with the same texts one is looked at
        alone = large.groupBy("s1", "s2").agg(F.min(F.struct("path", "centres")).alias("one")).select("s1", "s2", "one.*")
        crowd = held.drop("m").join(large.select("path"), "path")
        if level == LEVELS:
            crowd = signed(crowd)
        crowd = settle(crowd)
        if level >= DEEPEST:
            # alike in all coordinates of the deepest path
            stars.append(crowd.join(alone.select("path", F.col("centres")[2].alias("dst")), "path").select("rep", "dst"))
            break
        dense = _dense(crowd, alone, least)
        # a node that does not come apart is tied to its centre as it is: full sets decide later
        stars.append(crowd.join(dense, "path").select("rep", "dst"))
        done = alone.join(dense, "path", "left_semi").select("s1", "s2")
        rest = large.join(done, ["s1", "s2"], "left_anti").select("path")
        open_ = crowd.join(rest, "path").select("path", "rep", "sig").mapInArrow(_next_paths(level), "path long, rep long, sig binary")
        level += 1
    with_sig = signed(small[0])
    for more in small[1:]:
        with_sig = with_sig.unionByName(more)
    links = with_sig.repartition("path").sortWithinPartitions("path").mapInArrow(tidied(_compare(least)), "src long, dst long")
    for more in stars:
        links = links.unionByName(more.select(F.greatest("rep", "dst").alias("src"), F.least("rep", "dst").alias("dst")).where("src <> dst"))
    return settle(links.distinct())


def _confirmed(sets: DataFrame, placed: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst) of texts alike on full sets that join all such texts of each coarse component of ``placed(rep, component, m)``; ``sets(rep, component, m, shingles)``.

    A component of up to BLOCK texts is one group of a task. Of a larger one, each text
    is first held against the component's centre, its smallest text; what that links is
    one from then on. Only the others still meet all texts, block by block: with all
    linked to the centre, nothing is copied.
    """
    asked = sets.where(F.col("m") <= BLOCK).select(F.xxhash64("component").alias("task"), "rep", F.lit(False).alias("tied"), "shingles")
    many, crowd = placed.where(F.col("m") > BLOCK).select("rep", "component"), sets.where(F.col("m") > BLOCK)
    links = None
    if many.limit(1).count():
        heads = settle(crowd.where("rep = component").select("component", F.col("shingles").alias("head")).dropDuplicates(["component"]))
        small = (heads.agg(F.sum(F.octet_length("head"))).first()[0] or 0) <= BROADCAST_NODES * 1024
        star = crowd.where("rep <> component").join(F.broadcast(heads) if small else heads, "component").select("rep", "component", "shingles", "head")
        links = settle(star.mapInArrow(_confirm_star(percent), "src long, dst long"))
        tied = links.select(F.col("src").alias("rep")).distinct().withColumn("tied", F.lit(True))
        known = many.join(tied, "rep", "left").withColumn("tied", F.coalesce("tied", F.lit(False)) | (F.col("rep") == F.col("component")))
        counts = settle(known.groupBy("component").agg(F.count_if(F.col("tied")).alias("inner"), F.count_if(~F.col("tied")).alias("outer")).where("outer > 0"))
        parts = [F.ceil(F.col(c) / F.lit(BLOCK)).cast("int") for c in ("inner", "outer")]
        dealt = known.join(counts, "component").select("rep", "component", "tied", parts[0].alias("inners"), parts[1].alias("outers"))
        dealt = dealt.withColumn("block", F.pmod(F.xxhash64("rep", F.lit(3)), F.when(F.col("tied"), F.col("inners")).otherwise(F.col("outers"))).cast("int"))
        # (0, outer block, inner block) and (1, outer block, outer block): a text that is not tied meets all, a tied one only those
        block, inners, outers = F.col("block"), F.sequence(F.lit(0), F.col("inners") - 1), F.sequence(F.lit(0), F.col("outers") - 1)
        crossed = F.transform(outers, lambda o: F.xxhash64("component", F.lit(0), o, block))
        inward = F.transform(inners, lambda o: F.xxhash64("component", F.lit(0), block, o))
        among = F.transform(outers, lambda o: F.xxhash64("component", F.lit(1), F.least(block, o), F.greatest(block, o)))
        met = F.when(F.col("tied"), crossed).otherwise(F.concat(inward, among))
        left = semi_by_filter(crowd, counts, "component").select("rep", "shingles")
        asked = asked.unionByName(left.join(dealt.select("rep", F.explode(met).alias("task"), "tied"), "rep").select("task", "rep", "tied", "shingles"))
    found = settle(asked.repartition("task").sortWithinPartitions("task").mapInArrow(tidied(_confirm(percent)), "src long, dst long"))
    return found if links is None else links.unionByName(found)


def _near_rows(docs: DataFrame, size: int, percent: int, id_col: str, text_col: str, trees: int) -> DataFrame:
    """Rows (doc_id, mark, n_shingles, component_id), one for each row of ``docs``; ``mark`` is a hash of the text."""
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), "text")
    rows = settle(own.mapInArrow(_set_rows(size), "doc_id long, mark long, n long, k1 long, k2 long, sig binary"))
    full = rows.where("n > 0 and doc_id is not null")
    # a node for each set; its text is read from its first row
    reps = full.groupBy("k1", "k2", "n").agg(F.min(F.struct("doc_id", "mark")).alias("place"), F.first("sig").alias("sig"))
    reps = settle(reps.withColumn("rep", F.monotonically_increasing_id()))
    # what is below is ruled out: four standard errors of the estimate under the threshold
    s = percent / 100
    least = s - 4 * (s * (1 - s) / COORDINATES) ** 0.5
    groups = components(_coarse_links(reps, least, trees))
    members = groups.groupBy("component").agg(F.count(F.lit(1)).alias("m"))
    placed = settle(groups.join(members, "component").select(F.col("node").alias("rep"), "component", "m").join(reps.select("rep", "place"), "rep").select("rep", "component", "m", "place.*"))
    wanted = semi_by_filter(own, placed, "doc_id").join(placed, ["doc_id", "mark"]).select("rep", "component", "m", "text")

    def sets_of(batches):
        for batch in batches:
            for part in slices(batch, "text", BATCH_BYTES):
                sets, offsets = shingles(texts_of(part, "text"), size)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], _binary(sets, offsets[1:])], names=["rep", "component", "m", "shingles"])

    sets = settle(wanted.mapInArrow(tidied(sets_of), "rep long, component long, m long, shingles binary"))
    found = components(_confirmed(sets, placed, percent))
    named = reps.select("k1", "k2", "n", "rep", F.col("place.doc_id").alias("low")).join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    least_id = named.where("component is not null").groupBy("component").agg(F.min("low").alias("least"))
    lead = settle(named.join(least_id, "component", "left").select("k1", "k2", "n", F.coalesce("least", "low").alias("component_id")))
    out = full.select("doc_id", "mark", "n", "k1", "k2").join(lead, ["k1", "k2", "n"]).select("doc_id", "mark", F.col("n").alias("n_shingles"), "component_id")
    return out.unionByName(rows.where("n = 0 or doc_id is null").select("doc_id", "mark", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def near_groups(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, kept), one for each row of ``docs``.

    Texts whose shingle sets have 100 * intersection >= ``percent`` * union are linked;
    a component's identifier is its smallest doc_id, and that row is kept. A text
    without words, or null, has no shingle and is linked with nothing. Rows with a null
    doc_id stand alone and are kept. Rows that repeat a doc_id are nodes of their own,
    by their texts. An empty table gives an empty result. Other columns are not read.

    Texts of equal sets are one node of the join; sets are compared by 64-bit hashes of
    their shingles. No pair of a group is written before it is confirmed.
    """
    return _near_rows(docs, size, percent, id_col, text_col, trees).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def without_near_copies(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", trees: int = TREES) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that `near_groups` does not keep.

    Rows go by identifier and text: of rows that repeat an identifier only those whose
    own text is a near copy of one with a smaller identifier. Rows with a null
    identifier or without words stay; any column names are allowed.
    """
    gone = settle(_near_rows(docs, size, percent, id_col, text_col, trees).where("doc_id <> component_id").select("doc_id", "mark").distinct())
    plain, back = plain_names(docs)
    at_id, at_text = (F.col(f"c{docs.columns.index(c)}") for c in (id_col, text_col))
    marked = plain.withColumn("doc_id", at_id.cast("long")).withColumn("mark", F.xxhash64(at_text.cast("string")))
    return back(without(marked, gone, ["doc_id", "mark"]))
