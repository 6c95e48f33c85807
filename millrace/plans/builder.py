"""Editing a recipe: steps that can be switched off, moved and undone."""

from __future__ import annotations

from dataclasses import dataclass, replace

from ..operators import ops
from .recipe import Recipe

REMEMBERED = 100


@dataclass(frozen=True)
class PipelineStep:
    op: ops.Op
    enabled: bool = True


class Builder:
    """Steps in order. Every change can be undone, the last hundred of them."""

    def __init__(self, steps: list[ops.Op] = ()):
        self._now = tuple(PipelineStep(op) for op in steps)
        self._past: list[tuple[PipelineStep, ...]] = []
        self._future: list[tuple[PipelineStep, ...]] = []

    @property
    def steps(self) -> tuple[PipelineStep, ...]:
        return self._now

    @property
    def ops(self) -> list[ops.Op]:
        """What would run: the steps that are switched on."""
        return [s.op for s in self._now if s.enabled]

    def _become(self, steps: tuple[PipelineStep, ...]) -> None:
        self._past = [*self._past, self._now][-REMEMBERED:]
        self._future = []
        self._now = steps

    def add(self, op: ops.Op, at: int | None = None) -> None:
        at = len(self._now) if at is None else at
        self._become((*self._now[:at], PipelineStep(op), *self._now[at:]))

    def remove(self, at: int) -> None:
        self._become((*self._now[:at], *self._now[at + 1 :]))

    def change(self, at: int, op: ops.Op) -> None:
        self._become((*self._now[:at], replace(self._now[at], op=op), *self._now[at + 1 :]))

    def move(self, at: int, to: int) -> None:
        rest = [*self._now[:at], *self._now[at + 1 :]]
        self._become((*rest[:to], self._now[at], *rest[to:]))

    def switch(self, at: int, enabled: bool) -> None:
        self._become((*self._now[:at], replace(self._now[at], enabled=enabled), *self._now[at + 1 :]))

    def use(self, steps: list[ops.Op]) -> None:
        """Replace all steps, as a preset does."""
        self._become(tuple(PipelineStep(op) for op in steps))

    def undo(self) -> bool:
        if not self._past:
            return False
        self._future.append(self._now)
        self._now = self._past.pop()
        return True

    def redo(self) -> bool:
        if not self._future:
            return False
        self._past.append(self._now)
        self._now = self._future.pop()
        return True

    def recipe(self, name: str) -> Recipe:
        return Recipe(name, self.ops)
