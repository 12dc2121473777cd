"""Column-expression builders over per-item class arrays.

Everything here returns a ``Column`` evaluated inside the JVM: array functions
for ranks and curves, and for the per-batch diversity matrices, with
intermediates bound to lambda variables (``let``) so nothing is evaluated twice.
Their plans and costs do not grow with more than C log C of the class count.
Fused outputs, picks and votes are made elsewhere (``operators.lattice``).
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tolerance used for picks: the lowest class whose value is within TOL of the
# best wins.  It makes picks independent of last-bit differences between
# engines (and between summation orders).
TOL = 1e-9


def json_literal(value, ddl: str) -> Column:
    """A constant of type ``ddl`` (e.g. ``array<int>``) from one JSON string:
    one literal instead of one expression per element; Catalyst folds the
    parse once at optimization time."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


def lsum(cols: list[Column]) -> Column:
    """Left-to-right sum ``((c0 + c1) + c2) + ...`` (fixed evaluation order)."""
    return reduce(lambda a, b: a + b, cols)


def elements(arr: Column, n: int) -> list[Column]:
    return [arr.getItem(k) for k in range(n)]


def pick(values: list[Column], largest: bool = True, tol: float = TOL) -> Column:
    """Index of the best value; the lowest index wins ties within ``tol``.

    NULL values are ignored; all NULL gives NULL.
    """
    return array_pick(F.array(*values), largest=largest, tol=tol)


def array_pick(arr: Column, n: int | None = None, largest: bool = True, tol: float = TOL) -> Column:
    """``pick`` over an array: the plan does not grow with the class count and
    the best value is found once.  A class of value NULL is never picked."""
    near = (lambda v, b: v >= b - F.lit(tol)) if largest else (lambda v, b: v <= b + F.lit(tol))
    best = F.array_max if largest else F.array_min
    return let(arr, lambda a: let(best(a), lambda b: F.nullif(
        F.array_position(F.transform(a, lambda v: near(v, b)), True), F.lit(0)).cast("int") - 1))


def avg_rank_desc(arr: Column) -> Column:
    """Average ranks, 1 = highest score; ties share the mean of their ranks,
    i.e. the middle between their first and last place in sorted order.  A
    NULL has no rank."""
    def ranks(up, down):
        twice = lambda v: (F.size(up) + 1) - F.array_position(up, v) + F.array_position(down, v)
        return F.transform(arr, lambda v: F.when(v.isNotNull(), twice(v) / F.lit(2.0)))
    return let(F.array_sort(F.filter(arr, lambda x: x.isNotNull())),
               lambda up: let(F.reverse(up), lambda down: ranks(up, down)))


def _places(order: Column) -> Column:
    """Places (from 1) of a permutation's values: sorting it once more, with
    each value's place beside it, writes the places back in order of the values."""
    return F.transform(F.array_sort(F.transform(order, lambda p, t: F.struct(p.alias("p"), (t + 1).alias("t")))),
                       lambda s: s.getField("t"))


def ordinal_rank_desc(arr: Column) -> Column:
    """Ordinal ranks, 1 = highest score; ties go to the lower class index.  A
    NULL has no rank."""
    order = F.transform(F.array_sort(F.transform(arr, lambda v, k: F.struct(v.isNull().alias("u"), (-v).alias("v"), k.alias("k")))),
                        lambda s: s.getField("k"))
    return F.zip_with(arr, _places(order), lambda v, r: F.when(v.isNotNull(), r.cast("double")))


def minmax_row(arr: Column) -> Column:
    """Row-wise min-max scaling; a constant row gives NULLs."""
    lo, hi = F.array_min(arr), F.array_max(arr)
    return F.transform(arr, lambda x: F.try_divide(x - lo, hi - lo))


def rsc_desc(arr: Column) -> Column:
    """Rank-score characteristic of one item: min-max scaled scores sorted
    from best to worst."""
    return F.sort_array(minmax_row(arr), asc=False)


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable
    (inside higher-order functions a repeated sub-expression would be
    re-evaluated at every use)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def cd_of(a: Column, b: Column, n: int) -> Column:
    """Cognitive diversity of two RSC arrays bound to lambda variables."""
    sq = F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0),
                     lambda acc, z: acc + z)
    return F.sqrt(sq / F.lit(float(n)))


def order_of(a: Column) -> Column:
    """Positions of ``a`` in ascending order of value, ties by position."""
    return F.transform(F.array_sort(F.transform(a, lambda v, p: F.struct(v.alias("v"), p.alias("p")))),
                       lambda s: s.getField("p"))


def ksi_of(order_a: Column, a: Column, b: Column, n: int) -> Column:
    """xi dissimilarity of B given A, with A's ascending ``order_a`` already
    computed; all arguments are lambda-bound, intermediates via ``let``."""
    if n < 2:
        return F.lit(None).cast("double")

    def steps(r):
        return F.aggregate(F.sequence(F.lit(1), F.lit(n - 1)), F.lit(0),
                           lambda acc, t: acc + F.abs(F.get(r, t) - F.get(r, t - 1)))

    total = let(let(F.transform(order_a, lambda p: F.get(b, p)), lambda x: _places(order_of(x))), steps)
    has_null = F.exists(a, lambda x: x.isNull()) | F.exists(b, lambda x: x.isNull())
    return F.when(~has_null, F.lit(3.0) * total / F.lit(float(n * n - 1)))


def has_ties(arr: Column) -> Column:
    return F.size(F.array_distinct(arr)) < F.size(arr)
