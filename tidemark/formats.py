"""Formats of a user's own beside those of the engine.

A format is a pattern of its lines and a function that builds the plan of an entry from the pattern's groups. While it is
registered, detection scores it, folding starts events at its lines, and parsing reads them, all in the same plan as the
formats of the engine.

    with registered(Format("bar", r"^([^|]+)\\|([^|]+)\\|(.*)$", 3, lambda g: entry(stamp=stamps.iso(g[0]), level=levels.named(g[1]), message=g[2]))):
        result = ingest(files)
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column

from tidemark.schema import FORMATS


@dataclass(frozen=True)
class Format:
    """``line``: the pattern of a whole line, with ``groups`` groups. ``entry``: the fields of the entry of an array of those groups, as
    ``operators.parse.entry`` makes it. ``start``: what detection looks for at the start of a line; by default ``line``.
    """

    name: str
    line: str
    groups: int
    entry: Callable[[Column], dict[str, Column]]
    start: str | None = None

    def __post_init__(self) -> None:
        if not re.fullmatch(r"[a-z][a-z0-9_]*", self.name) or self.name in FORMATS:
            raise ValueError(f"{self.name!r} is no name for a format")
        if re.compile(self.line).groups != self.groups:
            raise ValueError(f"the pattern of {self.name!r} has not {self.groups} groups")


ADDED: dict[str, Format] = {}


def register(added: Format) -> None:
    ADDED[added.name] = added


def unregister(name: str) -> None:
    ADDED.pop(name, None)


@contextmanager
def registered(*added: Format) -> Iterator[None]:
    """Within it plans are built with ``added``; a plan keeps them after it."""
    before = dict(ADDED)
    for one in added:
        register(one)
    try:
        yield
    finally:
        ADDED.clear()
        ADDED.update(before)


def known() -> list[str]:
    return [*FORMATS, *ADDED]
