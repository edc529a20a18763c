"""An ordered cursor over a DataFrame of (key, value), read lazily partition by partition."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame


class Cursor:
    """rows(target) is the ordered snapshot from a target key on, or all of it for None."""

    def __init__(self, rows: Callable[[str | None], DataFrame]):
        self._rows = rows
        self._it: Iterator | None = None
        self._row = None

    def seek_to_first(self) -> None:
        self._start(None)

    def seek(self, target: str) -> None:
        """Moves to the first live key at or after target, within the bounds of the cursor."""
        self._start(target)

    def _start(self, target: str | None) -> None:
        self._it = iter(self._rows(target).toLocalIterator())
        self._row = next(self._it, None)

    def _ready(self) -> None:
        if self._it is None:
            self.seek_to_first()

    def valid(self) -> bool:
        self._ready()
        return self._row is not None

    def key(self) -> str | None:
        self._ready()
        return None if self._row is None else self._row["key"]

    def value(self) -> str | None:
        self._ready()
        return None if self._row is None else self._row["value"]

    def advance(self) -> None:
        self._ready()
        if self._row is not None:
            self._row = next(self._it, None)

    def __iter__(self) -> Cursor:
        return self

    def __next__(self) -> tuple[str, str]:
        if not self.valid():
            raise StopIteration
        out = (self.key(), self.value())
        self.advance()
        return out
