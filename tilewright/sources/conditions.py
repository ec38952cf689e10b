"""Conditions that a data source tests before it opens a file or reads a member.

They travel as an option of one scan. Filters that Spark pushes into a Python source stay with the relation:
measured on 4.1.2, a later query over the same DataFrame without a filter read with those of the one before and
lost rows. So the sources take none from Spark, and callers name what a scan needs:
``where=[("shard", "in", ["a.tar"]), ("pos", "<", 100)]``. All conditions must hold.
"""

from __future__ import annotations

import json
import operator
from collections.abc import Iterable

_TESTS = {
    "=": operator.eq,
    "!=": operator.ne,
    "<": operator.lt,
    "<=": operator.le,
    ">": operator.gt,
    ">=": operator.ge,
    "in": lambda v, values: v in values,
    "startswith": lambda v, prefix: str(v).startswith(prefix),
}
Where = Iterable[tuple[str, str, object]]


def option(where: Where) -> str:
    return json.dumps([list(c) for c in where])


class Conditions:
    """Tests by column; a column that the source does not know is an error."""

    def __init__(self, text: str, columns: Iterable[str]):
        self.tests: dict[str, list[tuple[str, object]]] = {}
        for column, test, value in json.loads(text):
            if column not in set(columns) or test not in _TESTS:
                raise ValueError(f"condition {column!r} {test!r} is not one of {sorted(columns)} {sorted(_TESTS)}")
            self.tests.setdefault(column, []).append((test, value))

    def passes(self, column: str, value) -> bool:
        return all(_TESTS[test](value, v) for test, v in self.tests.get(column, ()))

    def last(self, column: str) -> float:
        """The largest number the conditions allow."""
        bounds = [float("inf")]
        for test, v in self.tests.get(column, ()):
            if test in ("=", "<", "<="):
                bounds.append(v)
            elif test == "in":
                bounds.append(max(v, default=-1))
        return min(bounds)
