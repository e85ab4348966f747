"""Checks of a rewritten table: content, order, exact rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from keelsort.functions.ordering import POSITION, col, sort_columns, with_position

SEEDS = (11, 12)


def _hashable(c: Column, kind: T.DataType) -> Column:
    """A value in a form that hashes: bytes of strings, entries of maps in the order of their keys, at any depth."""
    if isinstance(kind, T.StringType):
        return c.cast("binary")
    if isinstance(kind, T.MapType):
        return F.sort_array(F.transform(F.map_entries(c), lambda e: F.struct(_hashable(e["key"], kind.keyType).alias("key"), _hashable(e["value"], kind.valueType).alias("value"))))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType) and kind.fields:
        return F.when(c.isNotNull(), F.struct(*[_hashable(c[f.name], f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields)]))
    return c


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, sum1, xor1, sum2, xor2) that is the same for the same rows in any order; one aggregate without a shuffle of rows."""
    columns = [_hashable(col(f.name), f.dataType) for f in df.schema.fields]
    # nulls do not change a hash: their places are hashed as well
    nulls = [col(f.name).isNull().cast("int") for f in df.schema.fields]
    hashed = df.select(*[F.xxhash64(F.lit(s), *columns, *nulls).alias(f"h{i}") for i, s in enumerate(SEEDS, 1)])
    totals = [F.count(F.lit(1)).alias("rows")]
    for i in (1, 2):
        totals += [F.coalesce(F.sum(F.col(f"h{i}").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(f"sum{i}"), F.coalesce(F.bit_xor(f"h{i}"), F.lit(0).cast("long")).alias(f"xor{i}")]
    return hashed.agg(*totals)


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, in any order."""
    return fingerprint(a).first() == fingerprint(b).first()


def order_violations(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, null_placement: str = "at_end", partitions: int | None = None) -> DataFrame:
    """One row (rows, violations): neighbours in row order whose keys fall.

    Parts of the row order are checked side by side and stitched by their first and last
    rows.
    """
    placed, by = (df, [col(c) for c in order]) if order else (with_position(df), [F.col(c) for c in POSITION])
    rank = F.struct(*[x for i, k in enumerate(keys) for x in _comparable(df.schema[k].dataType, k, null_placement, i)])
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = placed.select(rank.alias("_key"), *[c.alias(f"_o{i}") for i, c in enumerate(by)]).repartitionByRange(n, *[F.col(f"_o{i}") for i in range(len(by))]).withColumn("_part", F.spark_partition_id())
    window = Window.partitionBy("_part").orderBy(*[F.col(f"_o{i}") for i in range(len(by))])
    own = parts.withColumn("_at", F.row_number().over(window)).withColumn("_bad", F.coalesce((F.lag("_key").over(window) > F.col("_key")).cast("int"), F.lit(0)))
    summary = own.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.sum("_bad").alias("bad"), F.min_by("_key", "_at").alias("first"), F.max_by("_key", "_at").alias("last"))
    across = Window.orderBy("_part")
    joined = summary.withColumn("seam", F.coalesce((F.lag("last").over(across) > F.col("first")).cast("int"), F.lit(0)))
    return joined.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("rows"), F.coalesce(F.sum(F.col("bad") + F.col("seam")), F.lit(0)).cast("long").alias("violations"))


def _comparable(kind: T.DataType, key: str, null_placement: str, i: int) -> list[Column]:
    """A key as struct fields that compare in its sort order, without nulls."""
    c = col(key)
    number = isinstance(kind, (T.FloatType, T.DoubleType))
    at = F.when(c.isNull(), 2 if null_placement == "at_end" else -2)
    if number:
        at = at.when(F.isnan(c), 1 if null_placement == "at_end" else -1)
    out = [at.otherwise(0).alias(f"n{i}")]
    # where the flag decides the value is left out: null compares with null as equal
    value = F.when(c.isNull() | (F.isnan(c) if number else F.lit(False)), F.lit(None)).otherwise(c)
    return [*out, value.alias(f"v{i}")]


def differences(a: DataFrame, b: DataFrame, order_a: Sequence[str] | None = None, order_b: Sequence[str] | None = None) -> DataFrame:
    """Rows (row, columns) where two tables differ at the same row number; nulls equal nulls and NaN equals NaN, nested too."""
    from keelsort.operators.profile import numbered

    if [(f.name, f.dataType) for f in a.schema.fields] != [(f.name, f.dataType) for f in b.schema.fields]:
        raise ValueError("the tables differ in their columns")
    names = a.columns

    def placed(df, order, tag):
        own, by = (df, [col(c) for c in order]) if order else (with_position(df), [F.col(c) for c in POSITION])
        return numbered(own, by, "row").select("row", *[col(c).alias(f"{tag}{i}") for i, c in enumerate(names)], F.lit(1).alias(f"{tag}_in"))

    both = placed(a, order_a, "a").join(placed(b, order_b, "b"), "row", "full")
    odd = []
    for i, f in enumerate(a.schema.fields):
        x, y = F.col(f"a{i}"), F.col(f"b{i}")
        if isinstance(f.dataType, T.MapType):
            x, y = F.sort_array(F.map_entries(x)), F.sort_array(F.map_entries(y))
        odd.append(F.when(~x.eqNullSafe(y), F.lit(f.name)))
    missing = F.col("a_in").isNull() | F.col("b_in").isNull()
    found = both.select("row", F.when(missing, F.array(F.lit("(row)"))).otherwise(F.array_compact(F.array(*odd))).alias("columns"))
    return found.where(F.size("columns") > 0)


def range_bounds(df: DataFrame, keys: Sequence[str], ranges: int, identity: Sequence[str], null_placement: str = "at_end") -> DataFrame:
    """Rows (range_no, key columns): the keys of the rows at (i * n) // ranges of the sorted order, equal ones once."""
    from keelsort.operators.profile import numbered

    by = [*sort_columns(df.schema, keys, null_placement), *[col(c) for c in identity]]
    rows = df.count()
    at = sorted({(i * rows) // ranges for i in range(1, ranges)} - {0})
    found = numbered(df, by, "_row").where(F.col("_row").isin(at) if at else F.lit(False)).select("_row", *[col(k) for k in keys])
    first = found.groupBy(*[col(k) for k in keys]).agg(F.min("_row").alias("start_row"))
    return first.select((F.row_number().over(Window.orderBy("start_row"))).alias("range_no"), F.col("start_row"), *[col(k) for k in keys])
