"""Questions about populations that need no simulation."""

from __future__ import annotations

import math

from strandlake.simulation.spec import Spec


def size_at(spec: Spec, pop: int, t: float) -> float:
    """Size of a population t generations ago, by replaying the events before."""
    size, rate, since = spec.sizes[pop], (spec.growth or [0.0] * len(spec.sizes))[pop], 0.0
    for kind, when, *rest in sorted(spec.events, key=lambda e: e[1]):
        if when > t:
            break
        if kind in ("en", "eN") and (kind == "eN" or rest[0] == pop):
            size, rate, since = rest[-1], 0.0, when
        elif kind in ("eg", "eG") and (kind == "eG" or rest[0] == pop):
            size, rate, since = size * math.exp(-rate * (when - since)), rest[-1], when
    return size * math.exp(-rate * (t - since))


def links(spec: Spec) -> list[tuple[int, int]]:
    """Pairs of populations between which lineages can ever move."""
    out = [(i, j) for i, row in enumerate(spec.migration) for j, m in enumerate(row) if i != j and m]
    for kind, _, *rest in spec.events:
        if kind == "ej" or kind == "em" and rest[2] or kind == "cmig" and rest[4] > 0:
            out.append((rest[0], rest[1]))
        elif kind == "eM" and rest[0]:
            out += [(i, j) for i in range(len(spec.sizes)) for j in range(i)]
    return out


def connected(spec: Spec) -> bool:
    """Whether all samples can find a common ancestor."""
    label = list(range(len(spec.sizes)))
    for _ in label:
        for a, b in links(spec):
            label[a] = label[b] = min(label[a], label[b])
    return len({label[pop] for pop, _, n in spec.samples if n}) <= 1
