"""$search: terms as substrings of the searchable fields, whatever the case."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from odarel.errors import ODataError
from odarel.operators.scope import EntityScope, quoted
from odarel.plans.ast import Logic, Not, Term


def search_fields(scope: EntityScope, mode: str = "annotated") -> list[str]:
    fields = list(scope.entity.searchable)
    if not fields and mode == "all":
        fields = [c for c in scope.names() if isinstance(scope.types[scope.prefix + c], T.StringType)]
    if not fields:
        raise ODataError(f"{scope.entity.name} has no searchable fields")
    return fields[: scope.catalog.limits.search_fields]


def terms(tree) -> int:
    if isinstance(tree, Term):
        return 1
    return sum(map(terms, tree.terms)) if isinstance(tree, Logic) else terms(tree.term)


def search(scope: EntityScope, tree, mode: str = "annotated") -> Column:
    """A term is true if any field has it; a null field has nothing."""
    if terms(tree) > (most := scope.catalog.limits.search_terms):
        raise ODataError(f"$search takes {most} terms at most")
    fields = search_fields(scope, mode)

    def build(node) -> Column:
        if isinstance(node, Term):
            has = [F.coalesce(F.contains(F.lower(quoted(scope.prefix + f)), F.lit(node.text.lower())), F.lit(False)) for f in fields]
            return reduce(lambda a, b: a | b, has)
        if isinstance(node, Not):
            return ~build(node.term)
        parts = [build(x) for x in node.terms]
        return reduce((lambda a, b: a & b) if node.op == "and" else (lambda a, b: a | b), parts)

    return build(tree)
