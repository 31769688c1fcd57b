"""Undo and redo over immutable tables: each step keeps the table it made."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from pointweave.errors import require


@dataclass(frozen=True)
class Step:
    name: str
    table: DataFrame


class History:
    """Steps on a table and a place among them. Statistics are computed as a step is applied, so plans don't nest."""

    def __init__(self, table: DataFrame):
        self.steps, self.at = [Step("load", table)], 0

    @property
    def current(self) -> DataFrame:
        return self.steps[self.at].table

    def apply(self, name: str, change: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """A new step; steps that were undone are gone."""
        self.steps = [*self.steps[: self.at + 1], Step(name, change(self.current))]
        self.at += 1
        return self.current

    def can_undo(self) -> bool:
        return self.at > 0

    def can_redo(self) -> bool:
        return self.at + 1 < len(self.steps)

    def undo(self) -> DataFrame:
        require(self.can_undo(), "there is nothing to undo")
        self.at -= 1
        return self.current

    def redo(self) -> DataFrame:
        require(self.can_redo(), "there is nothing to redo")
        self.at += 1
        return self.current

    def undo_all(self) -> DataFrame:
        self.at = 0
        return self.current

    def names(self) -> list[str]:
        return [s.name for s in self.steps[1 : self.at + 1]]

    def clear(self) -> None:
        self.steps, self.at = [Step("load", self.current)], 0

    def copy_history_from(self, other: History) -> None:
        self.steps, self.at = list(other.steps), other.at
