import glob
import os
import random
import shutil

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from keelsort.operators import learning, rewrite, verify
from keelsort.plans.models import RewritePlan, SortPlan
from keelsort.sources import sampling, storage, writer


def rows(start, n):
    rng = random.Random(start)
    groups = [rng.randrange(7) for _ in range(n)]
    return pa.table({"position": pa.array(range(start, start + n), pa.int64()), "group": groups, "text": [f"category-{rng.randrange(19):02d}-{'x' * 140}" for _ in groups]})


@pytest.fixture()
def tree(tmp_path):
    for day in range(2):
        for part in range(2):
            at = tmp_path / "tree" / f"day={day}" / f"part-{part}.parquet"
            at.parent.mkdir(parents=True, exist_ok=True)
            pq.write_table(rows(1000 * (2 * day + part), 1000), at, compression="zstd", compression_level=1, row_group_size=100)
    (tmp_path / "tree" / "_hidden.parquet").write_bytes(b"no file")
    return tmp_path / "tree"


def test_inventory(spark, tree):
    found = storage.inventory(spark, str(tree))
    assert [f.relative for f in found] == ["day=0/part-0.parquet", "day=0/part-1.parquet", "day=1/part-0.parquet", "day=1/part-1.parquet"]
    assert storage.read_parquet(spark, str(tree)).columns == ["position", "group", "text"]
    assert storage.stable(found, storage.inventory(spark, str(tree)))
    with pytest.raises(FileNotFoundError):
        storage.inventory(spark, str(tree / "none"))
    with pytest.raises(ValueError):
        storage.inventory(spark, "s3a://bucket/path?x=1")


def test_schemas_must_agree(spark, tree):
    pq.write_table(pa.table({"position": [1]}), tree / "odd.parquet")
    with pytest.raises(ValueError):
        storage.read_parquet(spark, str(tree))


def test_arithmetic():
    assert storage.spread_indices(10, 2) == [2, 7] and storage.spread_indices(3, 9) == [0, 1, 2]
    assert storage.parse_shard("1/3") == (1, 3)
    assert [storage.parse_size(x) for x in ("10", "6GB", "2KiB", "1.5k")] == [10, 6_000_000_000, 2048, 1500]
    for bad in ("x", "1ib", "0", "-1"):
        with pytest.raises(ValueError):
            storage.parse_size(bad)
    for bad in ("3/3", "a/b", "1/0"):
        with pytest.raises(ValueError):
            storage.parse_shard(bad)
    assert sum(storage.weighted_files([10, 1000, 10, 1000], 3, 600).values()) == 600
    assert sampling.window_of([100, 100], 150, "s", "head") == (0, 150)
    start, n = sampling.window_of([100] * 10, 150, "0:a")
    assert n == 150 and 0 <= start <= 850 and (start, n) == sampling.window_of([100] * 10, 150, "0:a")


def test_shards_cover_once(spark, tree):
    names = [f.relative for f in storage.inventory(spark, str(tree))]
    df = spark.createDataFrame([(n,) for n in names], "name string").withColumn("s", storage.shard_column(F.col("name"), 3))
    assert {r["name"]: r["s"] for r in df.collect()} == {n: storage.shard_of(n, 3) for n in names}


def test_compression_is_resolved(spark, tree):
    found = storage.inspect_compression(storage.footers(spark, [f.path for f in storage.inventory(spark, str(tree))]))
    assert found.codec == "zstd"
    with pytest.raises(ValueError):
        storage.resolve_compression(found)
    assert storage.resolve_compression(found, "preserve", 5) == ("zstd", 5)
    assert storage.resolve_compression(found, "snappy") == ("snappy", None)
    known = storage.inspect_compression(storage.footers(spark, [storage.inventory(spark, str(tree))[0].path]), {"codec": "zstd", "level": 1})
    assert storage.resolve_compression(known) == ("zstd", 1)


@pytest.mark.parametrize("kind", writer.WRITERS)
def test_write(spark, tmp_path, kind):
    df = spark.createDataFrame(rows(0, 1000).to_pandas())
    plan = SortPlan("entropy", "entropy", ("group", "text"), total_rows=1000)
    out = str(tmp_path / "out.parquet")
    got = writer.write(df, out, plan=plan, writer=kind, row_group_size=300, order=["position"])
    assert got.action == "written" and got.output_bytes == os.path.getsize(out)
    meta = pq.read_metadata(out)
    assert meta.num_rows == 1000 and (meta.num_row_groups == 4 or kind == "spark")
    if kind == "arrow":
        assert [c.column_index for c in meta.row_group(0).sorting_columns] == [1, 2] and storage.PLAN_KEY.encode() in meta.metadata
    keys = [(r["group"], r["text"], r["position"]) for r in pq.read_table(out).to_pylist()]
    assert keys == sorted(keys)
    known = storage.inspect_compression(storage.footers(spark, [out]))
    assert storage.resolve_compression(known) == ("zstd", 1)
    with pytest.raises(FileExistsError):
        writer.write(df, out, plan=plan, order=["position"])
    assert verify.same_content(df, spark.read.parquet(out))
    assert verify.order_violations(spark.read.parquet(out), ["group", "text"]).first()["violations"] == 0
    assert not glob.glob(str(tmp_path / ".*.tmp"))


def test_write_ranges(spark, tmp_path):
    df = spark.createDataFrame(rows(0, 3000).to_pandas())
    plan = SortPlan("entropy", "entropy", ("text", "position"), total_rows=3000)
    writer.write(df, str(tmp_path / "out"), plan=plan, files=3, order=["position"])
    parts = [pq.read_table(p).to_pylist() for p in sorted(glob.glob(str(tmp_path / "out" / "*.parquet")))]
    keys = [(r["text"], r["position"]) for p in parts for r in p]
    assert len(parts) > 1 and keys == sorted(keys) and len(keys) == 3000


def test_rewrite_tree(spark, tree, tmp_path):
    plan = learning.fit_dataset(spark, str(tree), sample_rows=1500, sample_files=2, validation_files=1, validation_rows=500, compression="zstd", compression_level=1, algorithms=("entropy",))
    assert len(plan.validation) == 1 and plan.sort_keys
    out = str(tmp_path / "out")
    done = []
    got = rewrite.rewrite(spark, str(tree), out, plan, compression_level=1, workers=2, progress=done.append)
    assert len(done) == 4 and all(r.action in ("written", "kept") for r in got.results) and got.output_bytes <= got.source_bytes
    assert verify.same_content(storage.read_parquet(spark, str(tree)), storage.read_parquet(spark, out))
    again = rewrite.rewrite(spark, str(tree), out, plan, compression_level=1, workers=2)
    assert again.count("resumed") == 4
    with pytest.raises(FileExistsError):
        rewrite.rewrite(spark, str(tree), out, plan, compression_level=1, checkpoint=False)
    with pytest.raises(ValueError):
        rewrite.rewrite(spark, str(tree), str(tree / "inside"), plan, compression_level=1)
    with pytest.raises(ValueError):
        rewrite.rewrite(spark, str(tree), str(tmp_path / "unknown"), plan)
    assert not (tmp_path / "unknown").exists()
    parts = [rewrite.rewrite(spark, str(tree), str(tmp_path / "sharded"), plan, compression_level=1, shard=(i, 2)) for i in range(2)]
    assert sum(len(p.results) for p in parts) == 4


def test_no_keys_copy_bytes(spark, tree, tmp_path):
    source = str(tree / "day=0" / "part-0.parquet")
    got = rewrite.rewrite(spark, source, str(tmp_path / "copy.parquet"), RewritePlan(()), compression_manifest={"codec": "zstd", "level": 1})
    assert got.action == "copied" and open(source, "rb").read() == open(tmp_path / "copy.parquet", "rb").read()


def test_larger_results_are_not_published(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    pq.write_table(rows(0, 50), source, compression="zstd", compression_level=19)
    plan, out = RewritePlan(("position",)), str(tmp_path / "out.parquet")
    got = rewrite.rewrite(spark, source, out, plan, compression_manifest={"codec": "zstd", "level": 19})
    assert got.action == "kept" and open(source, "rb").read() == open(out, "rb").read()
    # what the caller asks for is written, whatever its size
    asked = [
        (plan, {"compression": "none"}),
        (plan, {"compression_manifest": {"codec": "zstd", "level": 19}, "skip_unchanged": False}),
        (RewritePlan(("position",), prefix_keys=("position",)), {"compression_manifest": {"codec": "zstd", "level": 19}}),
    ]
    for own, options in asked:
        got = rewrite.rewrite(spark, source, out, own, overwrite=True, **options)
        assert got.action == "written" and open(source, "rb").read() != open(out, "rb").read()
    assert os.listdir(tmp_path).count("out.parquet") == 1 and not glob.glob(str(tmp_path / "*.replaced"))


def test_leftovers_of_other_outputs_stay(spark, tmp_path):
    hidden = [f".{name}.keelsort-{'0' * 32}.tmp" for name in ("a.parquet", "b.parquet")]
    for name in hidden:
        (tmp_path / name).write_text("x")
    assert [p.rpartition("/")[2] for p in storage.stale_temporaries(spark, str(tmp_path), ["a.parquet"])] == hidden[:1]


def test_nested_maps_have_a_fingerprint(spark):
    df = spark.sql("select 1 as id, named_struct('m', map('a', 1, 'b', 2)) as s, array(map('x', 'y')) as l")
    same = spark.sql("select 1 as id, named_struct('m', map('b', 2, 'a', 1)) as s, array(map('x', 'y')) as l")
    other = spark.sql("select 1 as id, named_struct('m', map('a', 1, 'b', 3)) as s, array(map('x', 'y')) as l")
    assert verify.same_content(df, same) and not verify.same_content(df, other)


def test_types_that_would_change_are_refused(spark, tmp_path):
    source = str(tmp_path / "in.parquet")
    pq.write_table(pa.table({"a": pa.array([1, 2], pa.uint32())}), source)
    with pytest.raises(ValueError):
        rewrite.rewrite(spark, source, str(tmp_path / "out.parquet"), RewritePlan(("a",)))


def test_content_and_differences(spark):
    a = spark.createDataFrame([(1, "x", None), (2, None, [1.0])], "id long, s string, n array<double>")
    assert verify.same_content(a, a.orderBy(F.desc("id")))
    b = a.withColumn("s", F.lit("x"))
    assert not verify.same_content(a, b)
    assert [(r["row"], r["columns"]) for r in verify.differences(a, b, ["id"], ["id"]).collect()] == [(1, ["s"])]
    swapped = spark.createDataFrame([(1, None, None), (2, "x", [1.0])], "id long, s string, n array<double>")
    assert not verify.same_content(a, swapped)


def test_stream_of_batches(spark, tmp_path):
    from keelsort.streaming.apply import sorted_batches

    df = spark.createDataFrame(rows(0, 300).to_pandas())
    df.write.parquet(str(tmp_path / "in"))
    plan = RewritePlan(("group",))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(sorted_batches(plan, str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "state"))
    stream.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(*glob.glob(str(tmp_path / "out" / "*.parquet")))
    assert got.count() == 300 and verify.order_violations(got, ["group"]).first()["violations"] == 0


def test_cli(spark, tree, tmp_path, capsys):
    from keelsort.cli import parser, run, shown

    assert shown(1536) == "1.5 KiB" and shown(10) == "10 B"
    assert "sort keys" in run(parser().parse_args(["plan", str(tree), "--algorithm", "entropy"]), spark)
    plan = str(tmp_path / "plan.json")
    text = run(parser().parse_args(["fit", str(tree), plan, "--algorithm", "entropy", "--compression", "zstd", "--compression-level", "1", "--sample-files", "2", "--validation-files", "0"]), spark)
    assert text.startswith("keys:")
    assert "4 files" in run(parser().parse_args(["rewrite", str(tree), str(tmp_path / "out"), "--plan", plan, "--compression-level", "1"]), spark)
    shutil.rmtree(tmp_path / "out")
