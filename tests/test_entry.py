import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["profile_full_events", "planner_payload_orders", "frequency_order_orders", "range_bounds_customer", "stratified_windows_events", "run_cost_events", "shard_assignment_pages", "json_candidates_events"])
def test_queries_match_their_sql(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    df = entry.queries()[name](spark, sf)
    want = con.sql(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    a = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    b = sorted(repr(x) for x in want.select(*[f'"{c}"' for c in columns]).fetchall())
    assert a == b


def test_the_library_stands_without_the_training_data_operators():
    code = "import sys; sys.modules['keelsort.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert e.queries() and not any(k.startswith('op') for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=HERE, check=True, timeout=120)


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    from keelsort.session import local_dir

    assert local_dir("local[8]").startswith("/")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://https://host"):
        with pytest.raises(ValueError):
            local_dir(master)
