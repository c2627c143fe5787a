"""Entity sets, their keys, relations and tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from odarel.errors import ODataError


@dataclass(frozen=True)
class Relation:
    """A link to another set by equal keys.

    ``kind`` is one (at most one target per source) or many. An m:n relation names
    the set in between: source key = bridge's ``through_source``, bridge's ``through_target`` = target key.
    """

    name: str
    target: str
    source_key: str
    target_key: str
    kind: str = "one"
    through: str | None = None
    through_source: str | None = None
    through_target: str | None = None
    on_delete: str = "restrict"  # or cascade, for contained targets


@dataclass
class EntitySet:
    """A named table.

    ``json`` maps a JSON text column to the types of its paths; ``enums`` maps a column to its
    allowed values; ``etag`` names the column that changes with each write, ``delta`` the
    one that orders changes.
    """

    name: str
    keys: tuple[str, ...]
    load: Callable[[SparkSession], DataFrame]
    relations: dict[str, Relation] = field(default_factory=dict)
    searchable: tuple[str, ...] = ()
    json: dict[str, dict[str, str]] = field(default_factory=dict)
    enums: dict[str, tuple] = field(default_factory=dict)
    etag: str | None = None
    delta: str | None = None
    base: str | None = None

    def relate(self, *relations: Relation) -> EntitySet:
        self.relations.update({r.name: r for r in relations})
        return self


@dataclass(frozen=True)
class Limits:
    """What a request may ask for. Of more searchable fields than ``search_fields`` the first are searched; None searches all."""

    search_fields: int | None = 5
    search_terms: int = 5
    expand_depth: int = 5
    path_depth: int = 5
    joins: int = 8
    cascade: int = 5000


class Catalog:
    """Sets by name, whatever the case; tables are loaded once per session."""

    def __init__(self, spark: SparkSession, sets: list[EntitySet]):
        self.spark, self.limits = spark, Limits()
        self._sets = {s.name.lower(): s for s in sets}
        self._frames: dict[str, DataFrame] = {}

    def __iter__(self):
        return iter(self._sets.values())

    def get(self, name: str) -> EntitySet:
        if (found := self._sets.get(name.lower())) is None:
            raise ODataError(f"no entity set {name!r}", 404)
        return found

    def frame(self, name: str) -> DataFrame:
        found = self.get(name)
        if found.name not in self._frames:
            self._frames[found.name] = found.load(self.spark)
        return self._frames[found.name]

    def replace(self, name: str, frame: DataFrame) -> None:
        """Let later queries read ``frame`` for the set."""
        self._frames[self.get(name).name] = frame

    def state(self) -> tuple:
        """What queries depend on, to be compared with a later state: the frames themselves, and what the sets declare."""
        declared = {k: replace(s, relations=dict(s.relations), json={c: dict(v) for c, v in s.json.items()}, enums=dict(s.enums)) for k, s in self._sets.items()}
        return dict(self._frames), declared, self.limits

    def add(self, *sets: EntitySet) -> None:
        self._sets.update({s.name.lower(): s for s in sets})
