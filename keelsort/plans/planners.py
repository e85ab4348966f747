"""Choice of sort keys: rules over profiles, and greedy searches over measured costs.

A measured search asks a `Trials` object for the costs of a whole step at once, so that
the trials of a step run side by side in one Spark job.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass

from keelsort.plans.models import ColumnProfile

#: Names of the planning algorithms.
ALGORITHMS = ("auto", "none", "cardinality", "weighted", "entropy", "payload", "frequency", "runs", "codec", "codec_fast", "portfolio", "all")
LEAST_CHANGE = 0.0001
COVERED, MOST_TARGETS = 0.95, 32

Keys = tuple[str, ...]


def normalized(algorithm: str) -> str:
    name = algorithm.lower() if isinstance(algorithm, str) else algorithm
    if name not in ALGORITHMS:
        raise ValueError(f"algorithm must be one of {ALGORITHMS}")
    return name


def by_potential(p: ColumnProfile):
    return (-p.potential_bytes, p.sample_distinct, p.name)


def by_cardinality(p: ColumnProfile):
    return (p.sample_distinct, -p.potential_bytes, p.name)


def by_entropy(p: ColumnProfile):
    return (p.effective_cardinality, p.sample_distinct, -p.potential_bytes, p.name)


def by_payload(p: ColumnProfile):
    value = p.potential_bytes / max(1.0, math.log2(1.0 + p.effective_cardinality))
    return (-value, p.effective_cardinality, p.sample_distinct, -p.potential_bytes, p.name)


def candidates(profiles: Iterable[ColumnProfile], include: set[str] | None = None, prefix: Iterable[str] = ()) -> list[ColumnProfile]:
    """Columns worth a try: eligible, varied, repeating, and with runs left to gather."""
    taken = set(prefix)
    return [
        p
        for p in profiles
        if p.eligible
        and p.name not in taken
        and (include is None or p.name in include)
        and p.sample_distinct > 1
        and 1.0 - p.dominant_fraction >= LEAST_CHANGE
        and p.repeatability > LEAST_CHANGE
        and p.potential_bytes > 0
    ]


def ruled(algorithm: str, found: Sequence[ColumnProfile], slots: int) -> list[str]:
    """Keys by a rule: cardinality, weighted, entropy (also of frequency) or payload."""
    if algorithm == "weighted":
        found = sorted(found, key=by_potential)[:slots]
        algorithm = "cardinality"
    rule = {"cardinality": by_cardinality, "entropy": by_entropy, "frequency": by_entropy, "payload": by_payload}[algorithm]
    return [p.name for p in sorted(found, key=rule)[:slots]]


def run_targets(profiles: Iterable[ColumnProfile]) -> list[ColumnProfile]:
    """The largest columns that hold nearly all bytes: what a run cost is summed over."""
    fit = sorted((p for p in profiles if p.eligible and p.sample_distinct > 1 and p.byte_size > 0), key=lambda p: (-p.order_sensitive_bytes, p.name))
    total = sum(p.order_sensitive_bytes for p in fit)
    kept, covered = [], 0
    for p in fit:
        kept.append(p)
        covered += p.order_sensitive_bytes
        if len(kept) >= MOST_TARGETS or (total and covered / total >= COVERED):
            break
    return kept


class Trials:
    """Costs of key lists, each measured once; ``measure`` takes a list of (keys, value_order) and gives a dict with those that worked."""

    def __init__(self, measure: Callable[[list[tuple[Keys, str]]], dict[tuple[Keys, str], float]]):
        self.measure = measure
        self.known: dict[tuple[Keys, str], float | None] = {}
        self.evaluations = 0

    def costs(self, wanted: Sequence[tuple[Keys, str]]) -> dict[tuple[Keys, str], float]:
        new = [w for w in dict.fromkeys(wanted) if w not in self.known]
        if new:
            got = self.measure(new)
            self.evaluations += len(new)  # failed ones count too
            for w in new:
                self.known[w] = got.get(w)
        return {w: self.known[w] for w in wanted if self.known[w] is not None}

    def cost(self, keys: Sequence[str], value_order: str = "natural") -> float:
        w = (tuple(keys), value_order)
        return self.costs([w])[w]


@dataclass(frozen=True)
class Found:
    keys: tuple[str, ...]  # without the prefix
    baseline: float
    cost: float
    evaluations: int
    value_order: str = "natural"
    note: str | None = None


def greedy(trials: Trials, names: Sequence[str], prefix: Sequence[str], slots: int, least_gain: float, at_once: int | None = None, budget: int | None = None) -> Found:
    """Add the key of the lowest cost until none gains ``least_gain``.

    ``names`` are in order of promise. ``at_once`` limits a step to the first remaining
    ones, ``budget`` the evaluations of the whole search, the baseline and failures
    included. Ties go to the smaller name.
    """
    started = trials.evaluations
    current = baseline = trials.cost(prefix)
    chosen: list[str] = []
    left = list(names)
    while left and len(chosen) < slots:
        step = [(tuple([*prefix, *chosen, n]), "natural") for n in left[:at_once]]
        if budget is not None:
            room = max(0, budget - (trials.evaluations - started))
            fresh = 0
            allowed = []
            for w in step:
                if room - fresh <= 0:
                    break
                fresh += w not in trials.known
                allowed.append(w)
            step = allowed
        costs = trials.costs(step)
        if not costs:
            break
        best, name = min((c, keys[-1]) for (keys, _), c in costs.items())
        if (current - best) / current < least_gain if current else True:
            break
        chosen.append(name)
        left.remove(name)
        current = best
    return Found(tuple(chosen), baseline, current, trials.evaluations - started)


def proposals(found: Sequence[ColumnProfile], slots: int, rules: Sequence[str] = ("cardinality", "weighted", "entropy", "payload")) -> dict[tuple[Keys, str], str]:
    """Distinct key lists of the rules, each with the first rule that gave it."""
    out: dict[tuple[Keys, str], str] = {}
    for rule in rules:
        out.setdefault((tuple(ruled(rule, found, slots)), "frequency" if rule == "frequency" else "natural"), rule)
    return out


def chosen_of(trials: Trials, named: dict[tuple[Keys, str], str], prefix: Sequence[str], least_gain: float) -> Found:
    """The proposal of the lowest cost, the first of equals, if it beats the input order by ``least_gain``."""
    started = trials.evaluations
    wanted = [(tuple([*prefix, *keys]), order) for keys, order in named]
    costs = trials.costs([(tuple(prefix), "natural"), *wanted])
    base = costs.get((tuple(prefix), "natural"))
    if base is None:
        raise ValueError("the input order could not be measured")
    best, winner = base, None
    for w, own in zip(wanted, named):
        if w in costs and costs[w] < best:
            best, winner = costs[w], own
    spent = trials.evaluations - started
    if winner is None or (base - best) / base < least_gain:
        return Found((), base, base, spent, note="input order kept: no proposal gains enough")
    return Found(winner[0], base, best, spent, winner[1], f"{named[winner]} gave the smallest trial")


def portfolio(trials: Trials, found: Sequence[ColumnProfile], prefix: Sequence[str], slots: int, pool_size: int, least_gain: float) -> Found:
    pool = sorted(found, key=by_potential)[:pool_size]
    named = {k: v for k, v in proposals(pool, slots).items() if k[0]}
    return chosen_of(trials, named, prefix, least_gain)


def exhaustive(
    trials: Trials, run_trials: Trials, found: Sequence[ColumnProfile], prefix: Sequence[str], slots: int, pool_size: int, least_gain: float, least_run_gain: float, at_once: int, budget: int
) -> Found:
    """Score every algorithm's proposal by the same trials; the final scoring is not capped."""
    started = trials.evaluations
    pool = sorted(found, key=by_potential)[:pool_size]
    names = [p.name for p in pool]
    named: dict[tuple[Keys, str], str] = {}
    for of in (found, pool):
        for k, v in proposals(of, slots).items():
            named.setdefault(k, v)
    named.setdefault((tuple(ruled("frequency", found, slots)), "frequency"), "frequency")
    for label, search in (
        ("runs", lambda: greedy(run_trials, names, prefix, slots, least_run_gain)),
        ("codec_fast", lambda: greedy(trials, names, prefix, slots, least_gain, at_once, budget)),
        ("codec", lambda: greedy(trials, names, prefix, slots, least_gain)),
    ):
        named.setdefault((search().keys, "natural"), label)
    named = {k: v for k, v in named.items() if k[0]}
    best = chosen_of(trials, named, prefix, least_gain)
    return Found(best.keys, best.baseline, best.cost, trials.evaluations - started, best.value_order, best.note)
