"""Row order: sort expressions, row positions, value ranks and run counts.

A DataFrame has no order of its own. Every computation that depends on order takes an
explicit position: unique columns named by the caller, or those `with_position` adds
from the file a row was read from.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from keelsort.session import settle

NULL_PLACEMENTS = ("at_end", "at_start")
#: Columns that `with_position` adds.
POSITION = ("_row_file", "_row_index")
#: Rows that a range partition of a run count takes on.
RANGE_ROWS = 2_000_000


def quoted(name: str) -> str:
    """A column name as an identifier of the SQL and column syntax."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def check_placement(null_placement: str) -> None:
    if null_placement not in NULL_PLACEMENTS:
        raise ValueError("null_placement must be 'at_start' or 'at_end'")


def sortable(kind: T.DataType) -> bool:
    """Scalar types that may be keys; nested types, variants, intervals and nulls are carried only."""
    return isinstance(kind, (T.BooleanType, T.NumericType, T.StringType, T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType))


def sort_columns(schema: T.StructType, keys: Iterable[str], null_placement: str = "at_end") -> list[Column]:
    """Ascending sort expressions: values < NaN < null, or null < NaN < values for ``at_start``."""
    check_placement(null_placement)
    out: list[Column] = []
    for key in keys:
        if null_placement == "at_end":
            out.append(col(key).asc_nulls_last())
            continue
        if isinstance(schema[key].dataType, (T.FloatType, T.DoubleType)):
            out.append(F.when(col(key).isNull(), 0).when(F.isnan(col(key)), 1).otherwise(2).asc())
        out.append(col(key).asc_nulls_first())
    return out


def with_position(df: DataFrame) -> DataFrame:
    """Add the file and the row's index in it; where rows have no file, partition order.

    Needs a file scan or a projection of one: after a shuffle the file is gone and the
    position is that of the shuffled rows.
    """
    try:
        return df.select("*", F.col("_metadata.file_path").alias(POSITION[0]), F.col("_metadata.row_index").alias(POSITION[1]))
    except Exception as problem:
        if "_metadata" not in str(problem):
            raise
        return df.select("*", F.lit("").alias(POSITION[0]), F.monotonically_increasing_id().alias(POSITION[1]))


def changed(column: str, before: Column) -> Column:
    """Whether a value differs from the one before: nulls equal nulls, NaN equals NaN."""
    return ~col(column).eqNullSafe(before)


def run_counts(df: DataFrame, columns: Sequence[str], order: Sequence[Column], partitions: int | None = None) -> DataFrame:
    """Rows (column, rows, runs): adjacent equal values in the given total order.

    Rows are range-partitioned by ``order``; runs are counted in each part by a window of
    its own and the parts are stitched by their first and last values, so no task sees
    more than a part. Only the stitching, a row for each part, is in one task.
    """
    if partitions is None:
        partitions = max(1, min(4096, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = df.repartitionByRange(partitions, *order).withColumn("_part", F.spark_partition_id())
    window = Window.partitionBy("_part").orderBy(*order)
    numbered = parts.withColumn("_at", F.row_number().over(window))
    for i, c in enumerate(columns):
        numbered = numbered.withColumn(f"_c{i}", F.when(F.col("_at") == 1, 0).otherwise(changed(c, F.lag(col(c)).over(window)).cast("int")))
    aggregates = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(columns):
        aggregates += [F.sum(f"_c{i}").alias(f"c{i}"), F.min_by(F.struct(col(c).alias("v")), "_at").alias(f"f{i}"), F.max_by(F.struct(col(c).alias("v")), "_at").alias(f"l{i}")]
    summary = numbered.groupBy("_part").agg(*aggregates)
    across = Window.orderBy("_part")
    totals = [F.sum("n").alias("rows")]
    for i in range(len(columns)):
        before = F.lag(F.col(f"l{i}")).over(across)
        summary = summary.withColumn(f"j{i}", F.when(before.isNull(), 1).otherwise((~F.col(f"f{i}.v").eqNullSafe(before["v"])).cast("int")))
        totals.append((F.sum(f"c{i}") + F.sum(f"j{i}")).alias(f"r{i}"))
    one = summary.agg(*totals)
    pairs = [F.struct(F.lit(c).alias("column"), F.coalesce(F.col(f"r{i}"), F.lit(0)).cast("long").alias("runs")) for i, c in enumerate(columns)]
    return one.select(F.coalesce("rows", F.lit(0)).cast("long").alias("rows"), F.explode(F.array(*pairs)).alias("x")).select("x.column", "rows", "x.runs")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n): the exact histogram, null a value of its own."""
    return df.groupBy(col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def frequency_ranks(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, n, rank): values by falling count, ties by rising value, from 0; null has no rank.

    Distinct values are range-partitioned; a part's ranks start at the sizes of the parts
    before it, so that a column of many values is not ranked in one task.
    """
    counts = value_counts(df, column).where("value is not null")
    order = [F.desc("n"), F.asc("value")]
    parts = counts.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # written once: another evaluation would draw other range bounds
    own = settle(parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy(*order))))
    sizes = own.groupBy("_part").agg(F.max("_at").alias("size"))
    starts = sizes.select("_part", F.coalesce(F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    # a row for each part: bounded by the number of shuffle partitions
    return own.join(F.broadcast(starts), "_part").select("value", "n", (F.col("start") + F.col("_at") - 1).cast("long").alias("rank"))


def dense_ranks(df: DataFrame, column: str) -> DataFrame:
    """Rows (value, rank): distinct values by rising value, from 0; null has no rank."""
    values = df.select(col(column).alias("value")).where("value is not null").distinct().withColumn("n", F.lit(0))
    parts = values.repartitionByRange("value").withColumn("_part", F.spark_partition_id())
    own = settle(parts.withColumn("_at", F.row_number().over(Window.partitionBy("_part").orderBy("value"))))
    sizes = own.groupBy("_part").agg(F.max("_at").alias("size"))
    starts = sizes.select("_part", F.coalesce(F.sum("size").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return own.join(F.broadcast(starts), "_part").select("value", (F.col("start") + F.col("_at") - 1).cast("long").alias("rank"))


def check_keys(schema: T.StructType, keys: Sequence[str], prefix_keys: Sequence[str] = ()) -> None:
    """Keys exist, repeat nothing and are of types that sort."""
    wanted = [*prefix_keys, *keys]
    if len(set(wanted)) != len(wanted):
        raise ValueError("sort keys repeat a column")
    missing = [k for k in wanted if k not in schema.names]
    if missing:
        raise ValueError(f"sort keys not in table: {missing}")
    unfit = [k for k in wanted if not sortable(schema[k].dataType)]
    if unfit:
        raise ValueError(f"sort keys of unsupported types: {unfit}")


def frequency_order(df: DataFrame, keys: Sequence[str], prefix_keys: Sequence[str] = (), null_placement: str = "at_end") -> tuple[DataFrame, list[Column], list[str]]:
    """Join each key's frequency rank: the DataFrame, sort expressions (prefix natural, keys by rank) and the names of the added columns.

    A rank table is joined by Spark's choice of join, broadcast below its size threshold
    only; nulls stay without rank, NaN finds NaN.
    """
    check_placement(null_placement)
    check_keys(df.schema, keys, prefix_keys)
    order = sort_columns(df.schema, prefix_keys, null_placement)
    added = []
    out = df
    for i, key in enumerate(keys):
        name = f"_rank_{i}"
        ranks = frequency_ranks(df, key).select(F.col("value").alias(f"_value_{i}"), F.col("rank").alias(name))
        out = out.join(ranks, col(key) == F.col(f"_value_{i}"), "left").drop(f"_value_{i}")
        added.append(name)
        if null_placement == "at_start" and isinstance(df.schema[key].dataType, (T.FloatType, T.DoubleType)):
            order.append(F.when(col(key).isNull(), 0).otherwise(1).asc())
        order.append(F.col(name).asc_nulls_last() if null_placement == "at_end" else F.col(name).asc_nulls_first())
    return out, order, added
