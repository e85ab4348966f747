"""Queries over the standard tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from keelsort.functions.ordering import col, dense_ranks, frequency_order, frequency_ranks, run_counts, sort_columns, value_counts
from keelsort.operators import profile, verify
from keelsort.operators.profile import numbered
from keelsort.plans import planners
from keelsort.plans.models import ColumnProfile
from keelsort.sources import sampling
from keelsort.sources.storage import shard_column

#: Unique columns that stand for the row order of a table.
IDENTITY = {"orders": ["o_orderkey"], "events": ["event_id"], "customer": ["c_custkey"], "part": ["p_partkey"], "documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"]}
#: Columns that are profiled, with the bytes of a value (0: the bytes of the string).
COLUMNS = {
    "orders": {"o_orderkey": 8, "o_custkey": 8, "o_orderstatus": 0, "o_totalprice": 8, "o_orderdate": 8, "o_orderpriority": 0},
    "events": {"event_id": 8, "ts": 8, "user_id": 8, "event_type": 0, "value": 8},
    "customer": {"c_custkey": 8, "c_name": 0, "c_nationkey": 4, "c_acctbal": 8, "c_mktsegment": 0},
    "part": {"p_partkey": 8, "p_name": 0, "p_brand": 0, "p_type": 0, "p_size": 4, "p_retailprice": 8},
    "lineitem": {"l_orderkey": 8, "l_partkey": 8, "l_suppkey": 8, "l_linenumber": 4, "l_quantity": 8, "l_extendedprice": 8, "l_discount": 8, "l_tax": 8, "l_returnflag": 0, "l_linestatus": 0, "l_shipdate": 8},
}
PLANNED = ("orders", "events", "customer", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order(name: str):
    return [col(c) for c in IDENTITY[name]]


def histogram(name: str):
    def run(spark, sf_dir):
        d = profile.distributions(table(spark, sf_dir, name), list(COLUMNS[name]))
        return d.select("column", "rows", "ndv", F.round("dominant_fraction", 9).alias("dominant_fraction"), F.round("gini", 9).alias("gini"))

    return run


def _histogram_sql(name: str, c: str) -> str:
    return f"SELECT '{c}' AS \"column\", count(*) AS ndv, CAST(sum(n) AS BIGINT) AS \"rows\", max(n) AS most, sum(n::DOUBLE * n) AS sq FROM (SELECT {c}, count(*) AS n FROM {name} GROUP BY {c})"


def histogram_sql(name: str) -> str:
    union = " UNION ALL ".join(_histogram_sql(name, c) for c in COLUMNS[name])
    return f'SELECT "column", "rows", ndv, round(most / "rows", 9) AS dominant_fraction, round(greatest(0, 1 - sq / ("rows"::DOUBLE * "rows")), 9) AS gini FROM ({union})'


def runs(name: str):
    def run(spark, sf_dir):
        return run_counts(table(spark, sf_dir, name), list(COLUMNS[name]), _order(name))

    return run


def _runs_sql(name: str, c: str) -> str:
    by = ", ".join(IDENTITY[name])
    return f"SELECT '{c}' AS \"column\", CAST(sum(CASE WHEN first OR {c} IS DISTINCT FROM before THEN 1 ELSE 0 END) AS BIGINT) AS runs, count(*) AS \"rows\" FROM (SELECT {c}, lag({c}) OVER (ORDER BY {by}) AS before, row_number() OVER (ORDER BY {by}) = 1 AS first FROM {name})"


def runs_sql(name: str) -> str:
    return " UNION ALL ".join(f'SELECT "column", "rows", runs FROM ({_runs_sql(name, c)})' for c in COLUMNS[name])


def bytes_of(name: str):
    def run(spark, sf_dir):
        return profile.sizes(table(spark, sf_dir, name), list(COLUMNS[name])).select("column", "rows", "null_count", "byte_size", "order_sensitive_bytes")

    return run


def _bytes_sql(name: str, c: str, width: int) -> str:
    validity = f"CASE WHEN count({c}) < count(*) THEN CAST(ceil(count(*) / 8) AS BIGINT) ELSE 0 END"
    if width:
        whole, sensitive = f"count(*) * {width}", f"count({c}) * {width}"
    else:
        payload = f"coalesce(sum(strlen({c})), 0)"
        whole, sensitive = f"{payload} + 4 * (count(*) + 1)", payload
    return f"SELECT '{c}' AS \"column\", count(*) AS \"rows\", count(*) - count({c}) AS null_count, CAST({whole} + {validity} AS BIGINT) AS byte_size, CAST({sensitive} + {validity} AS BIGINT) AS order_sensitive_bytes FROM {name}"


def bytes_sql(name: str) -> str:
    return " UNION ALL ".join(_bytes_sql(name, c, w) for c, w in COLUMNS[name].items())


def full_profile(name: str):
    def run(spark, sf_dir):
        p = profile.profile_frame(table(spark, sf_dir, name), list(COLUMNS[name]), _order(name))
        rounded = [F.round(c, 9).alias(c) for c in ("dominant_fraction", "gini", "repeatability", "cluster_gain")]
        return p.select("column", "rows", "ndv", "runs", "null_count", "order_sensitive_bytes", *rounded, F.round("potential_bytes", 3).alias("potential_bytes"))

    return run


def _profile_cte(name: str) -> str:
    h = " UNION ALL ".join(_histogram_sql(name, c) for c in COLUMNS[name])
    r = " UNION ALL ".join(_runs_sql(name, c) for c in COLUMNS[name])
    return f"""h AS ({h}), r AS ({r}), b AS ({bytes_sql(name)}),
        p AS (SELECT h."column", h."rows", h.ndv, r.runs, b.null_count, b.order_sensitive_bytes, most / h."rows"::DOUBLE AS dominant_fraction,
                     greatest(0, 1 - sq / (h."rows"::DOUBLE * h."rows")) AS gini, greatest(0, 1 - ndv / h."rows"::DOUBLE) AS repeatability,
                     greatest(0, (runs - ndv) / runs::DOUBLE) AS cluster_gain
              FROM h JOIN r USING ("column") JOIN b USING ("column")),
        q AS (SELECT *, order_sensitive_bytes * cluster_gain * gini AS potential_bytes,
                     least(ndv, 1 / greatest(1.0 / "rows", 1 - gini)) AS eff FROM p)"""


def full_profile_sql(name: str) -> str:
    return f"""WITH {_profile_cte(name)}
        SELECT "column", "rows", ndv, runs, null_count, order_sensitive_bytes, round(dominant_fraction, 9) AS dominant_fraction, round(gini, 9) AS gini,
               round(repeatability, 9) AS repeatability, round(cluster_gain, 9) AS cluster_gain, round(potential_bytes, 3) AS potential_bytes FROM q"""


def planner(name: str, rule: str, slots: int = 4):
    def run(spark, sf_dir):
        rows = profile.profile_frame(table(spark, sf_dir, name), list(COLUMNS[name]), _order(name)).collect()  # a row for each column
        found = [
            ColumnProfile(r["column"], "", 0, r["order_sensitive_bytes"], r["null_count"], r["rows"], r["ndv"], r["runs"], r["dominant_fraction"], r["gini"], r["repeatability"], r["cluster_gain"], r["potential_bytes"], True)
            for r in rows
        ]
        keys = planners.ruled(rule, planners.candidates(found), slots)
        return spark.createDataFrame([(i, k) for i, k in enumerate(keys, 1)], "place int, column string")

    return run


def planner_sql(name: str, rule: str, slots: int = 4) -> str:
    by = {
        "cardinality": 'ndv, -potential_bytes, "column"',
        "weighted": 'ndv, -potential_bytes, "column"',
        "entropy": 'eff, ndv, -potential_bytes, "column"',
        "payload": '-potential_bytes / greatest(1, log2(1 + eff)), eff, ndv, -potential_bytes, "column"',
    }[rule]
    first = f', w AS (SELECT * FROM c ORDER BY -potential_bytes, ndv, "column" LIMIT {slots})' if rule == "weighted" else ", w AS (SELECT * FROM c)"
    return f"""WITH {_profile_cte(name)},
        c AS (SELECT * FROM q WHERE ndv > 1 AND 1 - dominant_fraction >= 0.0001 AND repeatability > 0.0001 AND potential_bytes > 0){first}
        SELECT CAST(row_number() OVER (ORDER BY {by}) AS INTEGER) AS place, "column" FROM w QUALIFY place <= {slots}"""


def natural_order(name: str, keys: list[str], placement: str):
    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        out = numbered(df, [*sort_columns(df.schema, keys, placement), *_order(name)], "new_row")
        return out.select(*IDENTITY[name], "new_row")

    return run


def natural_order_sql(name: str, keys: list[str], placement: str) -> str:
    side = "NULLS LAST" if placement == "at_end" else "NULLS FIRST"
    by = ", ".join([*(f"{k} {side}" for k in keys), *IDENTITY[name]])
    return f"SELECT {', '.join(IDENTITY[name])}, row_number() OVER (ORDER BY {by}) - 1 AS new_row FROM {name}"


def frequency_rank(name: str, column: str):
    def run(spark, sf_dir):
        return frequency_ranks(table(spark, sf_dir, name), column).select(F.col("value").cast("string").alias("value") if column in ("o_orderpriority", "event_type") else "value", "n", "rank")

    return run


def frequency_rank_sql(name: str, column: str) -> str:
    return f"SELECT {column} AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, {column}) - 1 AS rank FROM {name} WHERE {column} IS NOT NULL GROUP BY {column}"


def dense_rank(name: str, column: str):
    return lambda spark, sf_dir: dense_ranks(table(spark, sf_dir, name), column)


def dense_rank_sql(name: str, column: str) -> str:
    return f"SELECT {column} AS value, row_number() OVER (ORDER BY {column}) - 1 AS rank FROM (SELECT DISTINCT {column} FROM {name} WHERE {column} IS NOT NULL)"


def by_frequency(name: str, prefix: list[str], keys: list[str]):
    def run(spark, sf_dir):
        out, by, _ = frequency_order(table(spark, sf_dir, name), keys, prefix)
        return numbered(out, [*by, *_order(name)], "new_row").select(*IDENTITY[name], "new_row")

    return run


def by_frequency_sql(name: str, prefix: list[str], keys: list[str]) -> str:
    ctes = ", ".join(f"f{i} AS (SELECT {k} AS v, row_number() OVER (ORDER BY count(*) DESC, {k}) AS r FROM {name} WHERE {k} IS NOT NULL GROUP BY {k})" for i, k in enumerate(keys))
    joins = " ".join(f"LEFT JOIN f{i} ON f{i}.v = {k}" for i, k in enumerate(keys))
    by = ", ".join([*(f"{p} NULLS LAST" for p in prefix), *(f"f{i}.r NULLS LAST" for i in range(len(keys))), *IDENTITY[name]])
    return f"WITH {ctes} SELECT {', '.join(IDENTITY[name])}, row_number() OVER (ORDER BY {by}) - 1 AS new_row FROM {name} {joins}"


def run_cost(name: str, keys: list[str]):
    """Bytes times runs over rows of every column, summed, under an order."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        counted = run_counts(df, list(COLUMNS[name]), [*sort_columns(df.schema, keys), *_order(name)])
        sized = profile.sizes(df, list(COLUMNS[name])).select("column", "order_sensitive_bytes")
        return counted.join(sized, "column").agg(F.round(F.sum(F.col("order_sensitive_bytes") * F.col("runs") / F.col("rows")), 3).alias("cost"))

    return run


def run_cost_sql(name: str, keys: list[str]) -> str:
    by = ", ".join([*(f"{k} NULLS LAST" for k in keys), *IDENTITY[name]])
    one = " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", sum(CASE WHEN first OR {c} IS DISTINCT FROM before THEN 1 ELSE 0 END) AS runs, count(*) AS n FROM (SELECT {c}, lag({c}) OVER (ORDER BY {by}) AS before, row_number() OVER (ORDER BY {by}) = 1 AS first FROM {name})" for c in COLUMNS[name]
    )
    return f'WITH r AS ({one}), b AS ({bytes_sql(name)}) SELECT round(sum(order_sensitive_bytes * runs::DOUBLE / n), 3) AS cost FROM r JOIN b USING ("column")'


def windows(name: str, sample_rows: int):
    """The rows of a stratified sample."""

    def run(spark, sf_dir):
        df = table(spark, sf_dir, name)
        return profile.stratified_sample(df, df.count(), _order(name), sample_rows).select(*IDENTITY[name])

    return run


def windows_sql(name: str, sample_rows: int) -> str:
    ids = ", ".join(IDENTITY[name])
    return f"""WITH n AS (SELECT count(*) AS n FROM {name}), s AS (SELECT i, {sample_rows} // 16 + (CASE WHEN i < {sample_rows} % 16 THEN 1 ELSE 0 END) AS len FROM range(16) t(i)),
        w AS (SELECT i, round_even(i * (n - len) / 15.0, 0)::BIGINT AS lo, len FROM s, n),
        o AS (SELECT {ids}, row_number() OVER (ORDER BY {ids}) - 1 AS r FROM {name})
        SELECT {ids} FROM o JOIN w ON CASE WHEN (SELECT n FROM n) <= {sample_rows} THEN i = 0 ELSE r >= lo AND r < lo + len END"""


def bounds(name: str, keys: list[str], ranges: int):
    def run(spark, sf_dir):
        return verify.range_bounds(table(spark, sf_dir, name), keys, ranges, IDENTITY[name])

    return run


def bounds_sql(name: str, keys: list[str], ranges: int) -> str:
    by, ks = ", ".join([*(f"{k} NULLS LAST" for k in keys), *IDENTITY[name]]), ", ".join(keys)
    return f"""WITH o AS (SELECT {ks}, row_number() OVER (ORDER BY {by}) - 1 AS start_row, count(*) OVER () AS n FROM {name}),
        a AS (SELECT DISTINCT i * n // {ranges} AS cut FROM range(1, {ranges}) t(i), (SELECT count(*) AS n FROM {name}) WHERE i * n // {ranges} > 0),
        g AS (SELECT {ks}, min(start_row) AS start_row FROM o WHERE start_row IN (SELECT cut FROM a) GROUP BY {ks})
        SELECT CAST(row_number() OVER (ORDER BY start_row) AS INTEGER) AS range_no, start_row, {ks} FROM g"""


def range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each range of orders by total price, cut at the prices of `bounds`; lower bounds belong to the range above."""
    df = table(spark, sf_dir, "orders")
    cuts = verify.range_bounds(df, ["o_totalprice"], 8, ["o_orderkey"])
    # a row for each range, 8 at most
    return df.join(F.broadcast(cuts.select(F.col("o_totalprice").alias("low"))), F.col("o_totalprice") >= F.col("low"), "left").groupBy("o_orderkey").agg(F.count("low").alias("range_no")).groupBy("range_no").agg(F.count(F.lit(1)).alias("n"))


RANGE_COUNTS_SQL = """WITH o AS (SELECT o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS r, count(*) OVER () AS n FROM orders),
    c AS (SELECT DISTINCT o_totalprice AS low FROM o WHERE r IN (SELECT i * n // 8 FROM range(1, 8) t(i), (SELECT count(*) AS n FROM orders))),
    g AS (SELECT o_orderkey, count(low) AS range_no FROM orders LEFT JOIN c ON o_totalprice >= low GROUP BY o_orderkey)
    SELECT range_no, count(*) AS n FROM g GROUP BY range_no"""


def violations(name: str, keys: list[str]):
    def run(spark, sf_dir):
        return verify.order_violations(table(spark, sf_dir, name), keys, IDENTITY[name])

    return run


def violations_sql(name: str, key: str) -> str:
    ids = ", ".join(IDENTITY[name])
    return f"SELECT count(*) AS \"rows\", CAST(sum(CASE WHEN before > {key} THEN 1 ELSE 0 END) AS BIGINT) AS violations FROM (SELECT {key}, lag({key}) OVER (ORDER BY {ids}) AS before FROM {name})"


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", shard_column(F.col("url"), 7).alias("shard"))


def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    found = profile.json_like(df, ["event_type", "props"], _order("events"))
    return spark.createDataFrame([(c, c in found) for c in ("event_type", "props")], "column string, json_like boolean")


def _json_sql(c: str) -> str:
    return f"""SELECT '{c}' AS "column", count(*) FILTER (WHERE b) >= greatest(3, count(*) // 2) AND count(*) FILTER (WHERE b AND json_valid(v)) >= 0.8 * count(*) FILTER (WHERE b) AS json_like
        FROM (SELECT v, ltrim(v)[1] IN ('{{', '[') AS b FROM (SELECT {c} AS v FROM events WHERE {c} IS NOT NULL ORDER BY event_id LIMIT 24))"""


def roundtrip(name: str, algorithm: str):
    """Write sorted, read back: the rows of the table."""

    def run(spark, sf_dir):
        from keelsort.session import shared_dir
        from keelsort.sources.writer import write

        out = f"{shared_dir(spark)}/{name}.parquet"
        write(table(spark, sf_dir, name), out, algorithm, order=IDENTITY.get(name))
        return spark.read.parquet(out)

    return run


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree of two files, rewritten by a learnt plan and read back."""
    from keelsort.operators.learning import fit
    from keelsort.operators.rewrite import rewrite_dataset
    from keelsort.session import shared_dir
    from keelsort.sources import storage

    base = shared_dir(spark)
    df = table(spark, sf_dir, "customer")
    for i in range(2):
        df.where(F.pmod("c_custkey", F.lit(2)) == i).coalesce(1).write.parquet(f"{base}/raw-{i}")
        storage.rename(spark, storage.inventory(spark, f"{base}/raw-{i}")[0].path, f"{base}/tree/p{i}/part.parquet")
    plan = fit(storage.read_parquet(spark, f"{base}/tree"), ("entropy",), order=["c_custkey"])
    rewrite_dataset(spark, f"{base}/tree", f"{base}/out", plan, workers=2)
    return storage.read_parquet(spark, f"{base}/out")


def first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.head(table(spark, sf_dir, "orders"), 100, ["o_orderkey"])


def sampled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.key_sample(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["event_id"], 500)


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.fingerprint(table(spark, sf_dir, "lineitem"))


def trial_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The encoded sizes of a sample of orders under the orders of four rules."""
    from keelsort.operators.trial import trial_costs

    df = table(spark, sf_dir, "orders")
    rows = profile.profile_table(df, order=["o_orderkey"])
    named = planners.proposals(planners.candidates(rows), 4)
    sample = profile.stratified_sample(df, df.count(), _order("orders"))
    got = trial_costs(sample, df.columns, _order("orders"), list(named))
    return spark.createDataFrame([(named[w], ",".join(w[0]), int(c)) for w, c in got.items()], "rule string, sort_keys string, bytes long")


def search(algorithm: str):
    """Keys that a measured search chooses for customer."""

    def run(spark, sf_dir):
        from keelsort.operators.planning import plan_sort

        plan = plan_sort(table(spark, sf_dir, "customer"), algorithm, order=["c_custkey"], max_sort_columns=3)
        return spark.createDataFrame([(plan.algorithm, ",".join(plan.sort_keys), plan.value_order, plan.trial_evaluations)], "algorithm string, sort_keys string, value_order string, trials int")

    return run


def comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keelsort.operators.learning import benchmark, benchmark_frame

    results = benchmark(table(spark, sf_dir, "part"), ("none", "cardinality", "entropy", "frequency"), order=["p_partkey"])
    return benchmark_frame(spark, results).select("algorithm", "sort_keys", "output_bytes", "baseline_bytes", "savings")


def files_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Footers of the lineitem table by column and codec."""
    from keelsort.sources import storage

    found = storage.footers(spark, [f.path for f in storage.inventory(spark, f"{sf_dir}/lineitem.parquet")])
    return storage.footer_inventory(found)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        ORACLES[name] = sql


for _t in ("orders", "lineitem", "events", "customer", "part"):
    _add(f"profile_histogram_{_t}", histogram(_t), histogram_sql(_t))
    _add(f"order_sensitive_bytes_{_t}", bytes_of(_t), bytes_sql(_t))
for _t in PLANNED:
    _add(f"profile_runs_{_t}", runs(_t), runs_sql(_t))
    _add(f"profile_full_{_t}", full_profile(_t), full_profile_sql(_t))
    for _r in ("cardinality", "weighted", "entropy", "payload"):
        _add(f"planner_{_r}_{_t}", planner(_t, _r), planner_sql(_t, _r))
for _p in ("at_end", "at_start"):
    _add(f"natural_order_orders_{_p}", natural_order("orders", ["o_orderpriority", "o_orderstatus"], _p), natural_order_sql("orders", ["o_orderpriority", "o_orderstatus"], _p))
    _add(f"natural_order_events_{_p}", natural_order("events", ["event_type", "value"], _p), natural_order_sql("events", ["event_type", "value"], _p))
for _t, _c in (("lineitem", "l_quantity"), ("orders", "o_orderpriority"), ("events", "event_type"), ("events", "user_id")):
    _add(f"frequency_rank_{_c}", frequency_rank(_t, _c), frequency_rank_sql(_t, _c))
for _t, _c in (("lineitem", "l_shipdate"), ("customer", "c_mktsegment")):
    _add(f"dense_rank_{_c}", dense_rank(_t, _c), dense_rank_sql(_t, _c))
_add("frequency_order_orders", by_frequency("orders", ["o_orderstatus"], ["o_orderpriority", "o_custkey"]), by_frequency_sql("orders", ["o_orderstatus"], ["o_orderpriority", "o_custkey"]))
_add("frequency_order_events", by_frequency("events", [], ["event_type", "user_id"]), by_frequency_sql("events", [], ["event_type", "user_id"]))
_add("run_cost_orders", run_cost("orders", ["o_orderstatus", "o_orderpriority"]), run_cost_sql("orders", ["o_orderstatus", "o_orderpriority"]))
_add("run_cost_events", run_cost("events", ["event_type", "user_id"]), run_cost_sql("events", ["event_type", "user_id"]))
_add("stratified_windows_orders", windows("orders", 1000), windows_sql("orders", 1000))
_add("stratified_windows_nearly_all_orders", windows("orders", 14_990), windows_sql("orders", 14_990))
_add("stratified_windows_events", windows("events", 777), windows_sql("events", 777))
_add("range_bounds_orders", bounds("orders", ["o_totalprice"], 8), bounds_sql("orders", ["o_totalprice"], 8))
_add("range_bounds_customer", bounds("customer", ["c_mktsegment", "c_nationkey"], 16), bounds_sql("customer", ["c_mktsegment", "c_nationkey"], 16))
_add("range_counts_orders", range_counts, RANGE_COUNTS_SQL)
_add("monotonic_check_events", violations("events", ["user_id"]), violations_sql("events", "user_id"))
_add("monotonic_check_orders", violations("orders", ["o_totalprice"]), violations_sql("orders", "o_totalprice"))
_add("shard_assignment_pages", shards, "SELECT page_id, CAST(concat('0x', substr(sha256(url), 1, 16))::UBIGINT % 7 AS INTEGER) AS shard FROM pages")
_add("json_candidates_events", json_columns, f"{_json_sql('event_type')} UNION ALL {_json_sql('props')}")
_add("head_orders", first_rows, "SELECT * FROM orders ORDER BY o_orderkey LIMIT 100")
_add("rewrite_roundtrip_orders", roundtrip("orders", "entropy"), "SELECT * FROM orders")
_add("rewrite_roundtrip_embeddings", roundtrip("embeddings", "cardinality"), "SELECT * FROM embeddings")
_add("write_frequency_customer", roundtrip("customer", "frequency"), "SELECT * FROM customer")
_add("rewrite_dataset_customer", rewritten, "SELECT * FROM customer")
_add("value_counts_returnflag", lambda spark, sf_dir: value_counts(table(spark, sf_dir, "lineitem"), "l_returnflag"), "SELECT l_returnflag AS value, count(*) AS n FROM lineitem GROUP BY l_returnflag")
_add("key_sample_events", sampled_keys)
_add("fingerprint_lineitem", content)
_add("trial_bytes_orders", trial_bytes)
for _a in ("runs", "codec", "codec_fast", "portfolio", "all"):
    _add(f"search_{_a}_customer", search(_a))
_add("benchmark_part", comparison)
_add("footer_inventory_lineitem", files_read)
