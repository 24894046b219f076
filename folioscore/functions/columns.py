"""Small helpers over column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


Rules = Sequence[tuple[str, str]]


def substitute(text: Column, groups: Sequence[tuple[Sequence[str], Rules]]) -> Column:
    """Apply ordered ``(pattern, replacement)`` rules, group by group.

    A group with marks runs only on texts that contain one of them; a rule may
    stand under marks without which its pattern cannot match.
    """

    def apply(t: Column, rules: Rules) -> Column:
        for pattern, replacement in rules:
            t = F.regexp_replace(t, pattern, replacement)
        return t

    for marks, rules in groups:
        if not marks:
            text = apply(text, rules)
            continue

        def guarded(t: Column, marks=marks, rules=rules) -> Column:
            present = reduce(or_, [F.contains(t, F.lit(m)) for m in marks])
            return F.when(present, apply(t, rules)).otherwise(t)

        text = let(text, guarded)
    return text
