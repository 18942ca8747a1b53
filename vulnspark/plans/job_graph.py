"""A run as steps with declared tables, each with its own marker.

A step names the tables it reads and writes. It starts when the tables it
reads are there, and a marker of the run is written when it has ended, so a
run that stopped goes on at the step where it stopped. Steps can be repeated
with the same ``now`` and end in the same state.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from vulnspark.params import Params
from vulnspark.sources.state import StateStore


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[StateStore, int, Params], None]
    reads: tuple[str, ...] = ()
    writes: tuple[str, ...] = field(default=())


def check(steps: list[Step], given: tuple[str, ...]) -> None:
    """Every table a step reads is given or written by a step before it; every name is used once."""
    known, names = set(given), [s.name for s in steps]
    if len(set(names)) < len(names):
        raise ValueError(f"a step is named twice in {names}")
    for step in steps:
        missing = [t for t in step.reads if t not in known]
        if missing:
            raise ValueError(f"step {step.name} reads {missing}, which no step before it writes")
        known.update(step.writes)


def _marker(store: StateStore, run: str, step: str) -> str:
    return f"{store.root}/runs/{run}/{step}"


def done(store: StateStore, run: str) -> list[str]:
    """Steps of a run that have ended."""
    return sorted(store._children(f"{store.root}/runs/{run}"))


def run_steps(store: StateStore, steps: list[Step], now: int, p: Params = Params()) -> list[str]:
    """Run the steps of ``now`` that have not ended yet; their names."""
    run, ran = f"run-{now}", []
    for step in steps:
        fs, target = store._fs(_marker(store, run, step.name))
        if fs.exists(target):
            continue
        step.run(store, now, p)
        fs.create(target, True).close()
        ran.append(step.name)
    return ran


def forget(store: StateStore, before: int) -> None:
    """Drop the markers of runs before a time."""
    for name in store._children(f"{store.root}/runs"):
        if name.startswith("run-") and int(name[4:]) < before:
            store._remove(f"{store.root}/runs/{name}")
