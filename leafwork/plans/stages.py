"""Stages of a build, whether they are stale, and running those that are."""

from __future__ import annotations

import glob
import os
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class Stage:
    name: str
    run: Callable[[], None]
    outputs: tuple[str, ...]
    inputs: tuple[str, ...]


def newest(patterns: tuple[str, ...]) -> float | None:
    """Time of the last change below any of the patterns, None if nothing is there."""
    times = []
    for p in patterns:
        for path in glob.glob(p):
            inner = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs] if os.path.isdir(path) else [path]
            times += [os.path.getmtime(f) for f in inner]
    return max(times, default=None)


def status(stage: Stage) -> str:
    out, given = newest(stage.outputs), newest(stage.inputs)
    if out is None:
        return "MISSING"
    if given is None:
        return "NODEPS"
    return "STALE" if given > out else "FRESH"


def in_order(stages: list[Stage]) -> list[Stage]:
    """The stages so that each comes behind those whose outputs it reads; a ring of stages is an error."""
    left, done, out = list(stages), set(), []
    made = {o for s in stages for o in s.outputs}
    while left:
        ready = [s for s in left if all(i in done or i not in made for i in s.inputs)]
        if not ready:
            raise ValueError("stages wait for each other: " + ", ".join(s.name for s in left))
        out += ready
        done |= {o for s in ready for o in s.outputs}
        left = [s for s in left if s not in ready]
    return out


def rebuild(stages: list[Stage], every: bool = False) -> list[str]:
    """Run the stages in order, each judged anew before it runs; the first failure ends the pass. Names of those run."""
    done = []
    for s in stages:
        if every or status(s) in ("MISSING", "STALE"):
            s.run()
            done.append(s.name)
    return done
