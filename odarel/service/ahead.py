"""Rows read ahead for a client that follows links, so that many pages come from one plan."""

from __future__ import annotations

import json
import time
from collections.abc import Hashable
from copy import deepcopy
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row

from odarel.operators.query import Planned

#: Rows and, roughly, characters read at once at most; pages of more rows are read alone.
ROWS, CHARS = 1 << 16, 1 << 25
#: Seconds for which rows serve, and readers whose rows are kept.
SECONDS, READERS = 30, 4


@dataclass
class Stretch:
    """Rows that follow each other in an order, as ``shown`` has them, and where the pages given out of them end."""

    planned: Planned
    shown: DataFrame
    rows: list[Row]
    ended: bool  # there are no more
    total: int | None = None
    state: tuple = ()
    size: int = 0
    until: float = 0.0
    places: dict[str, int] = field(default_factory=dict)

    def holds(self, at: int, room: int) -> bool:
        """Whether a page from ``at`` on and the row after it are here, or the end is."""
        return self.ended or at + room < len(self.rows)


def place(values: list) -> str:
    return json.dumps(values, default=str)


def stable(df: DataFrame) -> bool:
    """Whether running the plan again gives the same rows: files as listed when loaded, or rows in memory; not a database, nothing random."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    leaves = plan.collectLeaves()
    for i in range(leaves.size()):
        leaf = leaves.apply(i)
        kind = leaf.getClass().getSimpleName()
        if kind == "LogicalRelation":
            kind = leaf.relation().getClass().getSimpleName()
        if kind not in ("HadoopFsRelation", "LocalRelation", "LogicalRDD", "Range", "OneRowRelation"):
            return False
    return True


class Ahead:
    """The last few readers' stretches by what they read.

    A reader's second page is read with the one after it, and each further stretch has twice the
    rows, up to a bound. A stretch serves only while what it was planned from is as it was, and for SECONDS at most.
    """

    def __init__(self) -> None:
        self._kept: dict[Hashable, Stretch] = {}

    def find(self, key: Hashable, state: tuple, values: list, room: int) -> tuple[Stretch, int] | None:
        """Rows for the page after ``values``, and the index where it begins."""
        if (found := self._current(key, state)) is None:
            return None
        at = found.places.get(place(values))
        return (found, at) if at is not None and found.holds(at, room) else None

    def _current(self, key: Hashable, state: tuple) -> Stretch | None:
        found = self._kept.get(key)
        return None if found is None or time.monotonic() > found.until or found.state != state else found

    def size(self, key: Hashable, state: tuple, room: int) -> int:
        """Rows to read for a page and those after it."""
        if (found := self._current(key, state)) is None:
            return max(room + 1, min(2 * room, ROWS))
        some = found.rows[: max(1, room)]
        chars = sum(len(str(r)) for r in some) / max(1, len(some))
        return max(room + 1, min(2 * found.size, ROWS, int(CHARS / max(1.0, chars))))

    def keep(self, key: Hashable, state: tuple, stretch: Stretch, size: int) -> None:
        stretch.state, stretch.size, stretch.until = deepcopy(state[:1]) + state[1:], size, time.monotonic() + SECONDS
        self._kept.pop(key, None)
        self._kept[key] = stretch
        for old in list(self._kept)[:-READERS]:
            self._kept.pop(old, None)
