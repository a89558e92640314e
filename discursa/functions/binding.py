"""Evaluate an expression once and use it many times inside another one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row: it is bound as a lambda variable.

    Spark repeats a sub-expression that many branches share whenever generated code grows
    past the JIT limit; a bound variable is never repeated.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def direct(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) unbound, for values that come straight out of a Python UDF."""
    return body(value)
