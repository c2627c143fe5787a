"""Functions, actions, hooks and executors that users add."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from odarel.errors import ODataError

EVENTS = ("READ", "CREATE", "UPDATE", "DELETE", "LINK", "UNLINK")


@dataclass(frozen=True)
class Operation:
    """A function (reads) or action (may write), bound to an entity, a collection or nothing.

    ``run(spark, df, **params)`` gets the entity's row or the collection as a DataFrame, or None.
    """

    name: str
    run: Callable
    params: dict[str, type] = field(default_factory=dict)
    binding: str = "unbound"  # entity, collection
    entity_set: str | None = None
    writes: bool = False

    def typed(self, given: dict[str, Any]) -> dict[str, Any]:
        if unknown := set(given) - set(self.params):
            raise ODataError(f"{self.name} has no parameter {min(unknown)!r}")
        out = {}
        for name, kind in self.params.items():
            if name not in given:
                raise ODataError(f"{self.name} needs {name!r}")
            try:
                out[name] = given[name] if kind is object or isinstance(given[name], kind) else kind(given[name])
            except (TypeError, ValueError):
                raise ODataError(f"{name!r} of {self.name} isn't a {kind.__name__}") from None
        return out


class Registry:
    def __init__(self):
        self.operations: dict[tuple[str | None, str], Operation] = {}
        self.hooks: dict[tuple[str, str, str], list[Callable]] = defaultdict(list)
        self.executors: list[tuple[Callable, Callable]] = []

    def function(self, name: str, **options) -> Callable:
        return lambda run: self._add(Operation(name, run, **options))

    def action(self, name: str, **options) -> Callable:
        return lambda run: self._add(Operation(name, run, writes=True, **options))

    def _add(self, operation: Operation) -> Operation:
        if operation.binding not in ("unbound", "collection", "entity") or (operation.binding != "unbound") != bool(operation.entity_set):
            raise ValueError(f"{operation.name}: a bound operation names its entity set")
        self.operations[(operation.entity_set.lower() if operation.entity_set else None, operation.name)] = operation
        return operation

    def find(self, name: str, entity_set: str | None = None) -> Operation:
        found = self.operations.get((entity_set.lower() if entity_set else None, name))
        if found is None:
            raise ODataError(f"no operation {name!r}", 404)
        return found

    def hook(self, when: str, event: str, entity_set: str = "*") -> Callable:
        """``when`` is before, on or after. An ``on`` hook that returns something takes the operation's place."""
        if when not in ("before", "on", "after") or event not in EVENTS:
            raise ValueError(f"no hook {when} {event}")

        def add(run: Callable) -> Callable:
            self.hooks[(when, event, entity_set.lower())].append(run)
            return run

        return add

    def run(self, when: str, event: str, entity_set: str, context: dict) -> Any:
        out = None
        for name in ("*", entity_set.lower()):
            for run in self.hooks.get((when, event, name), ()):
                result = run(context)
                out = result if result is not None else out
        return out

    def executor(self, supports: Callable, execute: Callable) -> None:
        """A strategy for $apply: ``supports(context)``, then ``execute(context)`` gives a DataFrame or None to decline."""
        self.executors.append((supports, execute))
