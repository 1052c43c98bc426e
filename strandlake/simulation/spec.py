"""What a replicate simulates: samples, populations, inversions, events."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

#: Event -> its arguments after the time, which comes first.  Times are generations ago.
EVENTS = {
    "en": "pop size",  # size from here on; growth stops
    "eN": "size",
    "eg": "pop rate",  # growth from here on; the size at this time is kept
    "eG": "rate",
    "em": "dst src rate",
    "eM": "rate",
    "ej": "src dst",  # all lineages of src move to dst
    "eig": "inversion rate",  # rate of gene flux
    "cmig": "src dst kary inversion proportion",  # lineages of one arrangement move, each with this probability
}


@dataclass(frozen=True)
class Inversion:
    """[left, right) that does not recombine between arrangements until ``age``; ``path``: (time, frequency) steps."""

    left: float
    right: float
    age: float = math.inf
    frequency: float = 0.5
    path: tuple[tuple[float, float], ...] = ()
    #: Tracts per lineage, generation and base of mean length, their mean length, and whether all have that length.
    flux: float = 0.0
    tract: float = 300.0
    fixed: bool = False

    def steps(self) -> tuple[tuple[float, float], ...]:
        return self.path or ((0.0, self.frequency),)


@dataclass(frozen=True)
class Sweep:
    """A selected allele at ``site`` in one population; ``path``: (time, frequency) steps from its end to its origin."""

    site: float
    pop: int
    path: tuple[tuple[float, float], ...]

    @property
    def end(self) -> float:
        return self.path[0][0]

    @property
    def origin(self) -> float:
        return self.path[-1][0]


@dataclass(frozen=True)
class Spec:
    """samples: (population, karyotype, count), a karyotype being a string of S and I, one for each inversion."""

    samples: tuple[tuple[int, str, int], ...]
    length: float = 1.0
    sizes: tuple[float, ...] = (1000.0,)
    recombination: float = 0.0
    growth: tuple[float, ...] = ()
    migration: tuple[tuple[float, ...], ...] = ()
    inversions: tuple[Inversion, ...] = ()
    events: tuple[tuple, ...] = ()
    sweep: Sweep | None = None
    mutation: float = 0.0
    extra: dict = field(default_factory=dict, compare=False)

    def __post_init__(self) -> None:
        for kind, _, *rest in self.events:
            if kind not in EVENTS or len(rest) != len(EVENTS[kind].split()):
                raise ValueError(f"{kind} takes a time and {EVENTS.get(kind)}")
        for _, karyotype, _ in self.samples:
            if len(karyotype) != len(self.inversions):
                raise ValueError("a karyotype has a letter for each inversion")
