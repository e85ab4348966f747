"""Column profiles: histograms of all columns in one pass, runs, bytes."""

from __future__ import annotations

import functools
import itertools
import json
import operator
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from keelsort.functions.ordering import POSITION, col, run_counts, sortable, with_position
from keelsort.plans.models import ColumnProfile
from keelsort.session import settle

SAMPLE_ROWS = 250_000
STRATA = 16
#: Columns of one grouping-sets pass; the grouping id has a bit for each.
SETS_AT_ONCE = 32


def stratified_windows(rows: int, sample_rows: int | None, strata: int = STRATA) -> list[tuple[int, int]]:
    """(start, length) of evenly spaced windows that make up a sample; the whole table where it is no larger.

    Starts are rounded half to even.
    """
    if sample_rows is not None and sample_rows <= 0:
        raise ValueError("sample_rows must be positive or None")
    if sample_rows is None or sample_rows >= rows:
        return [(0, rows)] if rows else []
    n = max(1, min(strata, sample_rows))
    each, more = divmod(sample_rows, n)
    lengths = [each + (i < more) for i in range(n)]
    if n == 1:
        return [((rows - lengths[0]) // 2, lengths[0])]
    return [(round(i * (rows - k) / (n - 1)), k) for i, k in enumerate(lengths) if k]


def numbered(df: DataFrame, order: Sequence[Column], name: str = "_row") -> DataFrame:
    """Add the 0-based number of each row in a total order, without a window over all rows."""
    from pyspark.sql import Window

    parts = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # written once: another evaluation would draw other range bounds
    own = settle(parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = own.groupBy("_part").agg(F.max("_at").alias("size"))
    starts = sizes.select("_part", F.coalesce(F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    # a row for each part: bounded by the number of shuffle partitions
    return own.join(F.broadcast(starts), "_part").withColumn(name, (F.col("start") + F.col("_at") - 1).cast("long")).drop("_part", "_at", "start")


def stratified_sample(df: DataFrame, rows: int, order: Sequence[Column], sample_rows: int | None = SAMPLE_ROWS, strata: int = STRATA) -> DataFrame:
    """The rows of `stratified_windows`, one for each window that holds it; the table itself where it is no larger.

    Windows overlap where the sample is nearly as large as the table.
    """
    windows = stratified_windows(rows, sample_rows, strata)
    if not windows or windows == [(0, rows)]:
        return df
    held = [F.col("_row").between(start, start + length - 1) for start, length in windows]
    inside = functools.reduce(operator.or_, held)
    sample = numbered(df, order).where(inside)
    if any(a + n > b for (a, n), (b, _) in itertools.pairwise(windows)):
        times = functools.reduce(operator.add, [h.cast("int") for h in held])
        sample = sample.withColumn("_copy", F.explode(F.sequence(F.lit(1), times))).drop("_copy")
    return sample.drop("_row")


def distributions(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows (column, rows, ndv, dominant_fraction, gini): one grouping-sets pass for up to SETS_AT_ONCE columns.

    Null counts as a value. An empty table gives no row for a column.
    """
    out = None
    for at in range(0, len(columns), SETS_AT_ONCE):
        own = list(columns[at : at + SETS_AT_ONCE])
        plain = df.select([col(c).alias(f"c{i}") for i, c in enumerate(own)])
        names = [f"c{i}" for i in range(len(own))]
        counts = plain.groupingSets([[F.col(n)] for n in names], *names).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("n"))
        all_bits = (1 << len(own)) - 1
        labels = F.create_map(*[x for i, c in enumerate(own) for x in (F.lit(all_bits ^ (1 << (len(own) - 1 - i))).cast("long"), F.lit(c))])
        found = counts.groupBy("gid").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("ndv"), F.max("n").alias("most"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"))
        found = found.select(
            labels[F.col("gid").cast("long")].alias("column"),
            F.col("rows").cast("long").alias("rows"),
            F.col("ndv").cast("long").alias("ndv"),
            (F.col("most") / F.col("rows")).alias("dominant_fraction"),
            F.greatest(F.lit(0.0), 1 - F.col("squares") / F.pow(F.col("rows").cast("double"), 2)).alias("gini"),
        )
        out = found if out is None else out.unionByName(found)
    return out


#: Bytes of a value of fixed width.
WIDTHS = {"tinyint": 1, "smallint": 2, "int": 4, "bigint": 8, "float": 4, "double": 8, "date": 4, "timestamp": 8, "timestamp_ntz": 8}


def sizes(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows (column, rows, null_count, byte_size, order_sensitive_bytes) of the whole table, by one aggregate.

    Order-sensitive bytes are those of values and of validity bits where there are nulls,
    without string offsets; fixed-width slots of nulls do not count. Nested columns are
    measured by their JSON text.
    """
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, f in enumerate(fields):
        aggregates.append(F.count(col(f.name)).alias(f"v{i}"))
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            aggregates.append(F.sum(F.octet_length(col(f.name))).alias(f"b{i}"))
        elif not isinstance(f.dataType, T.AtomicType) and not isinstance(f.dataType, T.NullType):
            aggregates.append(F.sum(F.octet_length(F.to_json(F.struct(col(f.name))))).alias(f"b{i}"))
    one = df.agg(*aggregates)
    rows = []
    for i, f in enumerate(fields):
        n, valid = F.col("n"), F.col(f"v{i}")
        validity = F.when(valid < n, F.ceil(n / 8)).otherwise(F.lit(0)).cast("long")
        width = 16 if isinstance(f.dataType, T.DecimalType) else WIDTHS.get(f.dataType.simpleString())
        if isinstance(f.dataType, T.BooleanType):
            slots = F.ceil(n / 8)
            sensitive, whole = F.coalesce(F.bround(slots * valid / n), F.lit(0)).cast("long") + validity, slots + validity
        elif width:
            sensitive, whole = valid * width + validity, n * width + validity
        elif f"b{i}" in one.columns:
            payload = F.coalesce(F.col(f"b{i}"), F.lit(0))
            sensitive, whole = payload + validity, payload + 4 * (n + 1) + validity
        else:
            sensitive = whole = validity
        rows.append(F.struct(F.lit(f.name).alias("column"), n.alias("rows"), (n - valid).alias("null_count"), whole.cast("long").alias("byte_size"), sensitive.cast("long").alias("order_sensitive_bytes")))
    return one.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def json_like(df: DataFrame, columns: Sequence[str], order: Sequence[Column], checks: int = 24) -> list[str]:
    """String columns whose first ``checks`` non-null values are mostly JSON objects or lists.

    At least 3 and half of the values must begin like one, and 80 % of those must parse.
    Each column reads ``checks`` rows.
    """
    found = []
    for c in columns:
        values = [r[0] for r in df.where(col(c).isNotNull() & F.is_valid_utf8(col(c))).orderBy(*order).select(col(c)).limit(checks).collect()]
        begun = [v for v in values if v.lstrip()[:1] in ("{", "[")]
        parsed = 0
        for v in begun:
            try:
                parsed += isinstance(json.loads(v), (dict, list))
            except ValueError:
                pass
        if len(begun) >= max(3, len(values) // 2) and parsed >= 0.8 * len(begun):
            found.append(c)
    return found


def derived(rows: int, ndv: int, runs: int, gini: float, sensitive: int) -> tuple[float, float, float]:
    """Repeatability, cluster gain and potential bytes."""
    repeatability = max(0.0, 1.0 - ndv / rows) if rows else 0.0
    gain = max(0.0, (runs - ndv) / runs) if runs else 0.0
    return repeatability, gain, float(sensitive) * gain * gini


def profile_frame(df: DataFrame, columns: Sequence[str], order: Sequence[Column], sample: DataFrame | None = None) -> DataFrame:
    """Profiles as a DataFrame, one row for each of the (sortable) columns; the sample is the table itself by default."""
    sample = df if sample is None else sample
    d = distributions(sample, columns)
    r = run_counts(sample, columns, order).select("column", "runs")
    s = sizes(df, columns).select("column", "null_count", "byte_size", "order_sensitive_bytes")
    gain = F.when(F.col("runs") > 0, F.greatest(F.lit(0.0), (F.col("runs") - F.col("ndv")) / F.col("runs"))).otherwise(F.lit(0.0))
    return (
        s.join(d, "column", "left")
        .join(r, "column", "left")
        .na.fill(0, ["rows", "ndv", "runs"])
        .na.fill(0.0, ["dominant_fraction", "gini"])
        .withColumn("repeatability", F.when(F.col("rows") > 0, F.greatest(F.lit(0.0), 1 - F.col("ndv") / F.col("rows"))).otherwise(F.lit(0.0)))
        .withColumn("cluster_gain", gain)
        .withColumn("potential_bytes", F.col("order_sensitive_bytes") * F.col("cluster_gain") * F.col("gini"))
    )


def profile_table(
    df: DataFrame, sample_rows: int | None = SAMPLE_ROWS, exclude: Iterable[str] = (), detect_json: bool = True, order: Sequence[str] | None = None
) -> tuple[ColumnProfile, ...]:
    """Profile every column; histograms and runs come from a stratified sample, bytes and nulls from the whole table.

    ``order`` names columns of a unique position; by default rows have the order of their
    files. Without rows all counts are zero.
    """
    if len(set(df.columns)) != len(df.columns):
        raise ValueError("table repeats a column name")
    exclude = set(exclude)
    unknown = exclude - set(df.columns)
    if unknown:
        raise ValueError(f"excluded columns not in table: {sorted(unknown)}")
    names = df.columns
    placed = df if order else with_position(df)
    by = [F.col(c) for c in (POSITION if not order else ())] or [col(c) for c in order]
    measured = {r["column"]: r for r in sizes(df).collect()}
    rows = next(iter(measured.values()))["rows"] if measured else 0
    sample = stratified_sample(placed, rows, by, sample_rows)
    fit = [c for c in names if c not in exclude and sortable(df.schema[c].dataType)]
    strings = [c for c in fit if isinstance(df.schema[c].dataType, T.StringType)]
    sample = sample.persist()
    try:
        documents = set(json_like(sample, strings, by)) if detect_json and strings else set()
        fit = [c for c in fit if c not in documents]
        counts = {r["column"]: r for r in distributions(sample, fit).collect()} if fit and rows else {}
        runs = {r["column"]: r["runs"] for r in run_counts(sample, fit, by).collect()} if fit and rows else {}
    finally:
        sample.unpersist()
    sampled = sum(n for _, n in stratified_windows(rows, sample_rows))
    out = []
    for c in names:
        m, d = measured[c], counts.get(c)
        reason = None
        if c in exclude:
            reason = "excluded"
        elif c in documents:
            reason = "JSON-like string"
        elif c not in fit:
            reason = "nested, extension, or unsupported type"
        eligible = reason is None
        ndv, most, gini = (d["ndv"], d["dominant_fraction"], d["gini"]) if d else (0, 0.0, 0.0)
        if eligible and ndv <= 1:
            reason = "constant in planning sample"
        repeatability, gain, potential = derived(sampled, ndv, runs.get(c, 0), gini, m["order_sensitive_bytes"])
        out.append(
            ColumnProfile(
                c, df.schema[c].dataType.simpleString(), m["byte_size"], m["order_sensitive_bytes"], m["null_count"], sampled, ndv, runs.get(c, 0), most, gini, repeatability, gain, potential, eligible, reason
            )
        )
    return tuple(out)
