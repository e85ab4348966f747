"""The pipeline's stages against brute force over the smallest tables."""

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")

import corpus_pipeline  # noqa: E402
from keelsort.llm import bpe, toxic  # noqa: E402
from keelsort.llm.queries import table, word_bpe  # noqa: E402
from test_llm_small import WORD, removed, sets_of  # noqa: E402


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    model = toxic.fit(docs, table(spark, sf, "labels"))
    scores = {r["doc_id"]: r["score"] for r in toxic.scores(docs, model).collect()}
    kept = {d: t for d, t in rows.items() if scores[d] < 0.5}
    last = {}
    for d, t in kept.items():
        last[t or ""] = max(d, last.get(t or "", d))
    kept = {d: kept[d] for d in sorted(last.values())}
    ids = list(kept)
    sets = sets_of([kept[d] for d in ids], 5)
    up = list(range(len(ids)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                    a, b = find(i), find(j)
                    up[max(a, b)] = min(a, b)
    kept = {d: kept[d] for i, d in enumerate(ids) if find(i) == i}
    cut = removed(list(kept.values()), 13)
    final = {d: (text if gone else kept[d]) for d, (_, gone, text) in zip(kept, cut)}
    got = {}
    for r in corpus_pipeline.run(spark, sf).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(final)
    vocab = bpe.vocabulary(word_bpe())
    for d, t in final.items():
        own = [*vocab.exact.encode(t or "", add_special_tokens=False).ids, 1]
        assert sum(r["length"] for r in got[d]) == len(own)
    used = {}
    for own in got.values():
        for r in own:
            used[r["sequence_id"]] = used.get(r["sequence_id"], 0) + r["length"]
    assert max(used.values()) <= 4096 and len(used) <= np.ceil(sum(used.values()) / 4096) + 2
    assert WORD.findall("a b") == ["a", "b"]


def test_stages_keep_the_columns(spark, sf):
    docs = table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:2]:
        assert stage(spark, docs, sf).columns == docs.columns, name
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "MinHash near-dedup", "substring dedup", "best-fit packing"]
