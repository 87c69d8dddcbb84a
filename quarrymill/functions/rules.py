"""Ordered rule sets as tables, and the one evaluator that they all run on.

A rule is (everything, some, nothing, gives): all tests of the first list hold, one of the second (if it has any), none of the
third. Tests are names; the caller says what Column a name stands for and what an outcome becomes. The first rule that
holds decides, a rule without tests always does, and where none holds the outcome is null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

Rule = tuple[Sequence[str], Sequence[str], Sequence[str], object]


def fires(rule: Rule, test: Callable[[str], Column]) -> Column | None:
    """Whether the rule holds; None for one without tests."""
    everything, some, nothing, _ = rule
    tests = [test(x) for x in everything] + [~test(x) for x in nothing]
    if some:
        tests.append(reduce(lambda a, b: a | b, [test(x) for x in some]))
    return reduce(lambda a, b: a & b, tests) if tests else None


def decide(rules: Sequence[Rule], test: Callable[[str], Column], gives: Callable[[object], Column | None]) -> Column:
    """The outcome of the first rule that holds."""
    out = F
    for rule in rules:
        held, outcome = fires(rule, test), gives(rule[3])
        if held is None:
            return outcome if out is F else out.otherwise(outcome)
        out = out.when(held, outcome)
    return F.lit(None) if out is F else out
