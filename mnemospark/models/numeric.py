"""Differentiation on vectors: one code path for values, gradients and Spark columns.

A Dual holds values (rows,) and derivatives (rows, parameters). The functions below take Duals,
Vars, plain arrays or Spark columns, so a model's recurrence is written once: training runs it on
Duals or Vars, a plan holds it as native expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Dual:
    """Values v (rows,) with derivatives g (rows, parameters) or (parameters,) for a scalar."""

    __slots__ = ("v", "g")
    __array_priority__ = 1000

    def __init__(self, v, g):
        self.v, self.g = v, g

    @staticmethod
    def parameters(w: np.ndarray) -> list[Dual]:
        return [Dual(np.float64(x), row) for x, row in zip(w, np.eye(len(w)), strict=True)]

    def __add__(self, o):
        return Dual(self.v + o.v, self.g + o.g) if isinstance(o, Dual) else Dual(self.v + o, _spread(self.g, o))

    __radd__ = __add__

    def __neg__(self):
        return Dual(-self.v, -self.g)

    def __sub__(self, o):
        return Dual(self.v - o.v, self.g - o.g) if isinstance(o, Dual) else Dual(self.v - o, _spread(self.g, o))

    def __rsub__(self, o):
        return Dual(o - self.v, -_spread(self.g, o))

    def __mul__(self, o):
        if isinstance(o, Dual):
            return Dual(self.v * o.v, _by(self.g, o.v) + _by(o.g, self.v))
        return Dual(self.v * o, _by(self.g, o))

    __rmul__ = __mul__

    def __truediv__(self, o):
        if isinstance(o, Dual):
            return Dual(self.v / o.v, _by(self.g, 1 / o.v) - _by(o.g, self.v / (o.v * o.v)))
        return Dual(self.v / o, _by(self.g, 1 / o))

    def __rtruediv__(self, o):
        return Dual(o / self.v, _by(self.g, -o / (self.v * self.v)))


def _by(g, x):
    """Derivatives scaled by values."""
    x = np.asarray(x)
    return g * x[..., None] if x.ndim else g * x


def _spread(g, o):
    o = np.asarray(o)
    return np.broadcast_to(g, (*o.shape, g.shape[-1])) if o.ndim and g.ndim == 1 else g


def value(x):
    return x.v if isinstance(x, (Dual, Var)) else x


def chain(x, v, slope):
    """v with the derivatives of x times slope, if x has any."""
    if isinstance(x, Var):
        return Var(v, x.tape, (x, slope, None))
    return Dual(v, _by(x.g, slope)) if isinstance(x, Dual) else v


def is_column(*x) -> bool:
    return any(isinstance(v, Column) for v in x)


def column(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def full(x, like):
    """A scalar for each element of like."""
    if isinstance(x, Var):
        return x
    if isinstance(x, Dual) and np.ndim(x.v) == 0:
        return Dual(x.v + np.zeros(len(like)), np.broadcast_to(x.g, (len(like), x.g.shape[-1])))
    return column(x) if is_column(like) else x + np.zeros(len(like))


def exp(x):
    if is_column(x):
        return F.exp(x)
    e = np.exp(value(x))
    return chain(x, e, e)


def log(x):
    if is_column(x):
        return F.ln(x)
    v = value(x)
    return chain(x, np.log(v), 1 / v) if isinstance(x, (Dual, Var)) else np.log(v)


def power(x, y):
    """x ** y for a positive x."""
    if is_column(x, y):
        return F.pow(column(x), column(y))
    if not isinstance(x, (Dual, Var)) and not isinstance(y, (Dual, Var)):
        return np.power(x, y)
    a, b = value(x), value(y)
    v = np.power(a, b)
    if isinstance(x, Var) or isinstance(y, Var):
        of = [(x, b * (v / a), None)] if isinstance(x, Var) else []
        of += [(y, v * np.log(a), None)] if isinstance(y, Var) else []
        return Var(v, of[0][0].tape, *of)
    g = 0.0
    if isinstance(x, Dual):
        g = g + _by(x.g, b * np.power(a, b - 1))
    if isinstance(y, Dual):
        g = g + _by(y.g, v * np.log(a))
    return Dual(v, g)


def where(mask, a, b):
    if is_column(mask):
        return F.when(mask, column(a)).otherwise(column(b))
    if isinstance(a, Var) or isinstance(b, Var):
        of = [(a, mask, None)] if isinstance(a, Var) else []
        of += [(b, ~mask, None)] if isinstance(b, Var) else []
        return Var(np.where(mask, value(a), value(b)), of[0][0].tape, *of)
    if not isinstance(a, Dual) and not isinstance(b, Dual):
        return np.where(mask, a, b)
    n = next(x.g.shape[-1] for x in (a, b) if isinstance(x, Dual))
    ga, gb = (x.g if isinstance(x, Dual) else np.zeros(n) for x in (a, b))
    return Dual(np.where(mask, value(a), value(b)), np.where(mask[:, None], ga, gb))


def clip(x, low=-np.inf, high=np.inf):
    """x held between bounds; where a bound holds, the derivative is zero."""
    if is_column(x):
        x = x if low == -math.inf else F.greatest(x, F.lit(float(low)))
        return x if high == math.inf else F.least(x, F.lit(float(high)))
    if not isinstance(x, (Dual, Var)):
        return np.clip(x, low, high)
    if isinstance(x, Var):
        return Var(np.clip(x.v, low, high), x.tape, (x, (x.v >= low) & (x.v <= high) | np.isnan(x.v), None))
    inside = (x.v >= low) & (x.v <= high) | np.isnan(x.v)
    return Dual(np.clip(x.v, low, high), _by(x.g, np.asarray(inside, float)))


def maximum(a, b):
    if is_column(a, b):
        return F.greatest(column(a), column(b))
    return where(np.broadcast_to(value(a) >= value(b), np.broadcast(value(a), value(b)).shape), a, b)


def minimum(a, b):
    if is_column(a, b):
        return F.least(column(a), column(b))
    return where(np.broadcast_to(value(a) <= value(b), np.broadcast(value(a), value(b)).shape), a, b)


# --- reverse mode: values (rows,) whose operations are noted on a tape ------------------------------


class Var:
    """Values v (rows,) noted on a tape, so that one walk back gives the slopes of all weights.

    of: (operand, slope or None for 1, rows of the operand, None for all or what makes the operand's
    slopes out of the result's). For many weights it costs a few times the values alone, where a Dual costs as much as all weights together.
    """

    __slots__ = ("v", "g", "of", "tape", "own")
    __array_ufunc__ = None

    def __init__(self, v, tape: list, *of):
        self.v, self.g, self.of, self.tape, self.own = v, None, of, tape, False
        tape.append(self)

    def __len__(self):
        return len(self.v)

    def __add__(self, o):
        if isinstance(o, Var):
            return Var(self.v + o.v, self.tape, (self, None, None), (o, None, None))
        return Var(self.v + o, self.tape, (self, None, None))

    __radd__ = __add__

    def __neg__(self):
        return Var(-self.v, self.tape, (self, -1.0, None))

    def __sub__(self, o):
        if isinstance(o, Var):
            return Var(self.v - o.v, self.tape, (self, None, None), (o, -1.0, None))
        return Var(self.v - o, self.tape, (self, None, None))

    def __rsub__(self, o):
        return Var(o - self.v, self.tape, (self, -1.0, None))

    def __mul__(self, o):
        if isinstance(o, Var):
            return Var(self.v * o.v, self.tape, (self, o.v, None), (o, self.v, None))
        return Var(self.v * o, self.tape, (self, o, None))

    __rmul__ = __mul__

    def __truediv__(self, o):
        if isinstance(o, Var):
            v = self.v / o.v
            return Var(v, self.tape, (self, 1 / o.v, None), (o, -v / o.v, None))
        return Var(self.v / o, self.tape, (self, 1 / o, None))

    def __rtruediv__(self, o):
        v = o / self.v
        return Var(v, self.tape, (self, -v / self.v, None))


def take(x, rows):
    """Some of the rows, none of them twice; a scalar stands for all rows."""
    if isinstance(x, Dual):
        return Dual(x.v[rows], x.g[rows]) if np.ndim(x.v) else x
    if isinstance(x, Var):
        return Var(x.v[rows], x.tape, (x, None, rows))
    return x[rows] if np.ndim(x) else x


def spread(x, rows: np.ndarray):
    """The rows given, each as often as it is named; a scalar stands for all rows."""
    if isinstance(x, Var):
        n = len(x.v)
        return Var(x.v[rows], x.tape, (x, None, lambda g: np.bincount(rows, g, n)))
    return take(x, rows)


def summed(x, rows: np.ndarray, n: int):
    """Sums (n,) of elements by the rows that they belong to."""
    if isinstance(x, Var):
        return Var(np.bincount(rows, x.v, n), x.tape, (x, None, lambda g: g[rows]))
    if isinstance(x, Dual):
        g = np.broadcast_to(x.g, (len(rows), x.g.shape[-1]))
        return Dual(np.bincount(rows, x.v, n), np.stack([np.bincount(rows, c, n) for c in g.T], 1))
    return np.bincount(rows, x, n)


def beside(xs: list, n: int):
    """(n * columns,): the first n rows of each column, row by row."""
    v, many = np.stack([value(x)[:n] for x in xs], 1).ravel(), len(xs)
    if isinstance(xs[0], Dual):
        return Dual(v, np.stack([x.g[:n] for x in xs], 1).reshape(len(v), -1))
    if not isinstance(xs[0], Var):
        return v

    def own(k: int, size: int) -> Callable:
        def back(g):
            out = np.zeros(size)
            out[:n] = g[k::many]
            return out

        return back

    return Var(v, xs[0].tape, *[(x, None, own(k, len(x.v))) for k, x in enumerate(xs)])


def joined(xs: list):
    """Rows one after another."""
    v = np.concatenate([value(x) for x in xs])
    for kind in (Dual, Var):
        some = [x for x in xs if isinstance(x, kind)]
        if some and kind is Dual:
            n = some[0].g.shape[-1]
            return Dual(v, np.concatenate([x.g if isinstance(x, Dual) else np.zeros((len(x), n)) for x in xs]))
        if some:
            ends = np.cumsum([len(value(x)) for x in xs]).tolist()
            return Var(v, some[0].tape, *[(x, None, lambda g, a=e - len(x.v), b=e: g[a:b]) for x, e in zip(xs, ends, strict=True) if isinstance(x, Var)])
    return v


class Taken:
    """Weights by row, of which some rows are taken when a weight is asked for."""

    def __init__(self, w: list, rows):
        self.w, self.rows, self.known = w, rows, {}

    def __getitem__(self, k: int):
        if k not in self.known:
            self.known[k] = take(self.w[k], self.rows)
        return self.known[k]


def walk_back(tape: list[Var], strict: bool = False) -> None:
    """Adds to g of all operands what g of the results asks for; strict, a zero stays one under any slope."""
    for x in reversed(tape):
        if x.g is None:
            continue
        for operand, slope, rows in x.of:
            g = x.g if slope is None else x.g * slope
            if strict:
                g = np.where(x.g == 0, 0.0, g)
            if callable(rows):
                g, rows = rows(g), None
            if rows is not None:
                if operand.g is None:
                    operand.g, operand.own = np.zeros(len(operand.v)), True
                elif not operand.own:
                    operand.g, operand.own = operand.g.copy(), True
                operand.g[rows] += g
            elif operand.g is None:
                operand.g = g
            else:
                operand.g, operand.own = operand.g + g, True
