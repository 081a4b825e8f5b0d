"""Options of the library: registered with a default, a check and an environment variable.

``settings.block_rows`` reads, ``settings.block_rows = 8`` sets, ``settings.override(...)`` sets
for a ``with`` block, ``CELLWEAVE_BLOCK_ROWS`` gives the value at start. Values from the
environment are checked like any other.
"""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

PREFIX = "CELLWEAVE_"
_TRUE, _FALSE = {"1", "true", "yes", "on"}, {"0", "false", "no", "off"}


@dataclass
class Option:
    name: str
    default: Any
    kind: type | tuple[type, ...]
    description: str = ""
    check: Callable[[Any], None] | None = None
    value: Any = field(default=None)
    deprecated: str | None = None
    touched: bool = False

    def accept(self, value: Any) -> Any:
        kinds = self.kind if isinstance(self.kind, tuple) else (self.kind,)
        if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
            raise TypeError(f"{self.name} must be of type {' or '.join(k.__name__ for k in kinds)}, not {type(value).__name__}")
        if self.check is not None and value is not None:
            self.check(value)
        return value

    def parse(self, text: str) -> Any:
        kinds = self.kind if isinstance(self.kind, tuple) else (self.kind,)
        low = text.strip().lower()
        if type(None) in kinds and low in ("", "none", "null"):
            return None
        if bool in kinds:
            if low in _TRUE | _FALSE:
                return low in _TRUE
            raise ValueError(f"{PREFIX}{self.name.upper()} must be one of {sorted(_TRUE | _FALSE)}, not {text!r}")
        if int in kinds:
            return int(text)
        return float(text) if float in kinds else text


class Settings:
    """Registry of options with attribute access."""

    def __init__(self) -> None:
        object.__setattr__(self, "_options", {})

    def register(self, name: str, default: Any, kind: type | tuple[type, ...], description: str = "", check: Callable[[Any], None] | None = None) -> None:
        if name in self._options or hasattr(type(self), name):
            raise ValueError(f"option {name!r} exists already")
        option = Option(name, default, kind, description, check)
        option.value = option.accept(default)
        text = os.environ.get(PREFIX + name.upper())
        if text is not None:
            option.value = option.accept(option.parse(text))
        self._options[name] = option

    def deprecate(self, name: str, message: str = "", removal_version: str | None = None) -> None:
        """Setting or reading the option warns from now on, and says when it will go."""
        self._of(name).deprecated = (message or f"option {name!r} is deprecated") + (f"; it will be removed in version {removal_version}" if removal_version else "")

    def describe(self, names: str | Iterable[str] | None = None) -> str:
        chosen = [names] if isinstance(names, str) else sorted(self._options) if names is None else list(names)
        return "\n".join(f"{o.name}: {o.description} (default {o.default!r}, now {o.value!r}, environment {PREFIX}{o.name.upper()})" for o in map(self._of, chosen))

    def reset(self, names: str | Iterable[str]) -> None:
        for name in [names] if isinstance(names, str) else names:
            option = self._of(name)
            option.value = option.default

    @contextmanager
    def override(self, **values: Any) -> Iterator[Settings]:
        before = {name: self._of(name).value for name in values}
        try:
            for name, value in values.items():
                setattr(self, name, value)
            yield self
        finally:
            for name, value in before.items():
                self._options[name].value = value

    def _of(self, name: str) -> Option:
        try:
            return self._options[name]
        except KeyError:
            raise AttributeError(f"no option {name!r}") from None

    def __getattr__(self, name: str) -> Any:
        option = self._of(name)
        if option.deprecated:
            warnings.warn(option.deprecated, FutureWarning, stacklevel=2)
        return option.value

    def __setattr__(self, name: str, value: Any) -> None:
        option = self._of(name)
        option.value = option.accept(value)

    def __dir__(self) -> list[str]:
        return sorted([*super().__dir__(), *self._options])

    def __repr__(self) -> str:
        return "Settings(" + ", ".join(f"{n}={o.value!r}" for n, o in sorted(self._options.items())) + ")"


def positive(value: int) -> None:
    if value <= 0:
        raise ValueError(f"must be positive, not {value}")


def rows_per_chunk(value: int) -> None:
    positive(value)
    if value > 100_000:
        warnings.warn(f"{value} rows in a chunk make reading few rows slow", UserWarning, stacklevel=4)


def rows_per_block(value: int) -> None:
    positive(value)
    if value > 256:
        raise ValueError(f"a block holds at most 256 rows, not {value}")
    if value & (value - 1):
        warnings.warn(f"{value} rows in a block is no power of two", UserWarning, stacklevel=4)


settings = Settings()
settings.register("max_rows_per_chunk", 8192, int, "rows in one partition directory of the row layout", rows_per_chunk)
settings.register("max_columns_per_chunk", 256, int, "columns in one partition directory of the column layout", positive)
settings.register("block_rows", 16, int, "rows in a block of the block format", rows_per_block)
settings.register("warn_on_large_queries", True, bool, "warn when a query asks for very many rows")
settings.register("large_query_threshold", 50_000, int, "rows beyond which a query counts as large", positive)
settings.register("override_memory_check", False, bool, "let local results exceed the memory limit with a warning")
settings.register("max_workers", None, (int, type(None)), "tasks that a local read uses; None leaves it to Spark", positive)
settings.register("min_nnz", 300, int, "entries that a kept cell has at least")
settings.register("broadcast_rows", 200_000, int, "most rows of a table that is broadcast", positive)
