"""Trials: the encoded size or run cost of a bounded sample under many orders, one Spark job for each step."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from keelsort.plans.models import ColumnProfile


def sort_order(table: pa.Table, keys: Sequence[str], position: str, value_order: str, prefix: Sequence[str], null_placement: str) -> pa.Array:
    """Stable permutation of a sample by keys, ties by ``position``."""
    import pyarrow.compute as pc

    columns, names = [], []
    for i, k in enumerate(keys):
        c = table.column(k)
        if value_order == "frequency" and k not in prefix:
            counts = pc.value_counts(c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c)
            values = counts.field("values")
            at = pc.sort_indices(pa.table({"n": counts.field("counts"), "v": values}), sort_keys=[("n", "descending"), ("v", "ascending")])
            c = pc.index_in(c, value_set=values.take(at).filter(pc.is_valid(values.take(at))))
            c = pc.if_else(pc.is_null(table.column(k)), pa.scalar(None, pa.int32()), c)
        columns.append(c)
        names.append(f"k{i}")
    columns.append(table.column(position))
    names.append("position")
    own = pa.Table.from_arrays(columns, names)
    return pc.sort_indices(own, sort_keys=[(n, "ascending") for n in names], null_placement=null_placement)


def encoded_size(table: pa.Table, compression, level) -> int:
    """Bytes of a Parquet file in memory: one row group, dictionaries, no statistics."""
    import pyarrow.parquet as pq

    sink = pa.BufferOutputStream()
    pq.write_table(table, sink, compression=compression, compression_level=level, use_dictionary=True, write_statistics=False, row_group_size=max(1, table.num_rows))
    return sink.getvalue().size


def run_cost(table: pa.Table, targets: Sequence[tuple[str, int]]) -> float:
    """Sum over targets of bytes times runs over rows; nulls equal nulls, NaN equals NaN."""
    import pyarrow.compute as pc

    n = table.num_rows
    if n <= 1:
        return 0.0
    cost = 0.0
    for name, size in targets:
        codes = table.column(name).combine_chunks().dictionary_encode(null_encoding="encode")
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        at = codes.indices
        runs = 1 + pc.sum(pc.not_equal(at.slice(0, n - 1), at.slice(1))).as_py()
        cost += size * runs / n
    return cost


def trial_costs(
    sample: DataFrame,
    columns: Sequence[str],
    position: Sequence[Column],
    wanted: Sequence[tuple[tuple[str, ...], str]],
    prefix: Sequence[str] = (),
    null_placement: str = "at_end",
    compression="zstd",
    level: int | None = None,
    targets: Sequence[ColumnProfile] | None = None,
) -> dict[tuple[tuple[str, ...], str], float]:
    """Cost of each (keys, value order): encoded bytes, or the run cost over ``targets`` where given.

    The sample has a bounded number of rows; every order is a task of its own. Orders
    that Arrow cannot sort or encode are left out of the result.
    """
    wanted = list(wanted)
    weights = None if targets is None else [(t.name, t.order_sensitive_bytes) for t in targets]
    names = list(columns)
    # columns travel under plain names: any name is allowed in a table
    plain = {c: f"c{i}" for i, c in enumerate(names)}
    from keelsort.functions.ordering import col

    dealt = sample.select(*[col(c).alias(plain[c]) for c in names], F.struct(*position).alias("_position")).withColumn("_trial", F.explode(F.array(*[F.lit(i) for i in range(len(wanted))])))

    def run(table: pa.Table) -> pa.Table:
        i = table.column("_trial")[0].as_py()
        keys, value_order = wanted[i]
        place = table.column("_position").combine_chunks()
        parts = place.flatten()
        import pyarrow.compute as pc

        before = pc.sort_indices(pa.Table.from_arrays(parts, [f"p{k}" for k in range(len(parts))]), sort_keys=[(f"p{k}", "ascending") for k in range(len(parts))])
        table = table.select([plain[c] for c in names]).take(before).rename_columns(names)
        try:
            if keys:
                own = table.append_column("\x00position", pa.array(range(table.num_rows)))
                table = table.take(sort_order(own, keys, "\x00position", value_order, prefix, null_placement))
            cost = run_cost(table, weights) if weights is not None else float(encoded_size(table, compression, level))
        except (pa.ArrowInvalid, pa.ArrowNotImplementedError, TypeError):
            return pa.table({"trial": pa.array([], pa.int32()), "cost": pa.array([], pa.float64())})
        return pa.table({"trial": pa.array([i], pa.int32()), "cost": pa.array([cost], pa.float64())})

    got = dealt.groupBy("_trial").applyInArrow(run, "trial int, cost double").collect()
    return {wanted[r["trial"]]: r["cost"] for r in got}
