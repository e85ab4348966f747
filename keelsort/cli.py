"""Command line: plan, fit, rewrite, benchmark."""

from __future__ import annotations

import argparse
import json
import sys

from keelsort.plans.models import RewritePlan
from keelsort.plans.planners import ALGORITHMS


def shown(size: int) -> str:
    """Bytes with a binary unit."""
    power = min(4, max(0, abs(size).bit_length() - 1) // 10)
    return f"{size} B" if power == 0 else f"{size / (1 << 10 * power):.1f} {' KMGT'[power]}iB"


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="keelsort", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def common(p, many=False):
        p.add_argument("source")
        p.add_argument("--prefix", action="append", default=[], help="a column that comes first; may repeat")
        p.add_argument("--null-placement", choices=("at_end", "at_start"), default="at_end")
        p.add_argument("--max-sort-columns", type=int, default=8)
        p.add_argument("--json", action="store_true")

    p = sub.add_parser("plan", help="choose sort keys")
    common(p)
    p.add_argument("--algorithm", default="auto", help=", ".join(ALGORITHMS))
    p.add_argument("--full", action="store_true", help="no sampling")
    p.add_argument("--rows", type=int, help="use the first rows only")
    p = sub.add_parser("fit", help="learn a plan for a file or tree")
    common(p)
    p.add_argument("plan")
    p.add_argument("--algorithm", action="append", help="may repeat")
    p.add_argument("--sample-rows", type=int, default=250_000)
    p.add_argument("--sample-files", type=int, default=32)
    p.add_argument("--sample-method", choices=("row_groups", "head"), default="row_groups")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--validation-files", type=int, default=4)
    p.add_argument("--compression", default="preserve")
    p.add_argument("--compression-level", default="preserve")
    p = sub.add_parser("rewrite", help="apply a plan to a file or tree")
    p.add_argument("source")
    p.add_argument("destination")
    p.add_argument("--plan")
    p.add_argument("--algorithm", default="auto")
    p.add_argument("--workers", type=int, default=1)
    p.add_argument("--shard", help="i/n")
    p.add_argument("--overwrite", action="store_true")
    p.add_argument("--compression", default="preserve")
    p.add_argument("--compression-level", default="preserve")
    p.add_argument("--writer", choices=("spark", "arrow"), default="spark")
    p.add_argument("--json", action="store_true")
    p = sub.add_parser("benchmark", help="compare algorithms under one writer")
    common(p)
    p.add_argument("--algorithm", action="append", help="may repeat")
    p.add_argument("--rows", type=int, help="use the first rows only")
    return top


def _level(text: str):
    known = {"preserve": "preserve", "default": None}
    return known[text] if text in known else int(text)


def run(args: argparse.Namespace, spark) -> str:
    from keelsort.operators import learning, rewrite
    from keelsort.operators.planning import plan_sort
    from keelsort.sources import sampling, storage

    if args.command in ("plan", "benchmark"):
        df = storage.read_parquet(spark, args.source)
        if args.rows:
            df = sampling.head(df, args.rows)
        options = {"prefix": args.prefix, "null_placement": args.null_placement, "max_sort_columns": args.max_sort_columns}
        if args.command == "plan":
            plan = plan_sort(df, args.algorithm, full=args.full, **options)
            return json.dumps(plan.as_dict(), indent=1) if args.json else plan.explain()
        results = learning.benchmark(df, args.algorithm or learning.COMPARED, **options)
        if args.json:
            return json.dumps([r.__dict__ | {"savings": r.savings} for r in results], indent=1)
        return "\n".join(f"{r.algorithm:12} {shown(r.output_bytes):>12} {r.savings:8.2%}  {', '.join(r.sort_keys) or '(input order)'}" for r in results)
    if args.command == "fit":
        options = {"prefix": args.prefix, "null_placement": args.null_placement, "max_sort_columns": args.max_sort_columns}
        if args.algorithm:
            options["algorithms"] = args.algorithm
        plan = learning.fit_dataset(
            spark, args.source, args.sample_rows, args.sample_files, args.sample_method, args.seed, validation_files=args.validation_files,
            compression=args.compression, compression_level=_level(args.compression_level), **options,
        )
        plan.save(args.plan)
        if args.json:
            return plan.to_json()
        checked = learning.savings_summary(plan.validation)
        return f"keys: {', '.join(plan.sort_keys) or '(input order)'}\nheld-out files: {checked['files']}" + (f", saved {checked['least']:.2%} to {checked['most']:.2%}, mean {checked['mean']:.2%}" if checked["files"] else "")
    plan = RewritePlan.load(args.plan) if args.plan else None
    options = {"overwrite": args.overwrite, "writer": args.writer}
    if plan is not None:
        options |= {"compression": args.compression, "compression_level": _level(args.compression_level)}
        if storage.is_directory(spark, args.source) and not args.destination.lower().endswith(".parquet"):
            options |= {"workers": args.workers, "shard": args.shard}
    else:
        options |= {"algorithm": args.algorithm}
    got = rewrite.rewrite(spark, args.source, args.destination, plan, **options)
    results = got.results if hasattr(got, "results") else (got,)
    if args.json:
        return json.dumps([{k: v for k, v in r.__dict__.items() if k != "plan"} for r in results], indent=1)
    total, made = sum(r.source_bytes for r in results), sum(r.output_bytes for r in results)
    actions = ", ".join(f"{sum(r.action == a for r in results)} {a}" for a in dict.fromkeys(r.action for r in results))
    return f"{len(results)} files ({actions}): {shown(total)} -> {shown(made)}"


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    from keelsort.session import local_session, ship

    spark = local_session("keelsort", "*")
    ship(spark)
    try:
        print(run(args, spark))
    except (ValueError, FileNotFoundError, FileExistsError) as problem:
        print(f"error: {problem}", file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
