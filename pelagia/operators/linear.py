"""State vectors (idx, value) and sparse matrices (row, col, value): algebra as joins, iterative drivers as loops of Spark jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged


def combine(a: DataFrame, b: DataFrame, x: float = 1.0, y: float = 1.0) -> DataFrame:
    """x * a + y * b; an index that one of them lacks counts as 0 there."""
    both = a.select("idx", (F.col("value") * x).alias("value")).unionAll(b.select("idx", (F.col("value") * y).alias("value")))
    return both.groupBy("idx").agg(F.sum("value").alias("value"))


def scale(a: DataFrame, x: float) -> DataFrame:
    return a.select("idx", (F.col("value") * x).alias("value"))


def inner(a: DataFrame, b: DataFrame) -> float:
    from .aggregates import dot

    return float(dot(a, b).first()[0] or 0.0)


def length(a: DataFrame) -> float:
    return inner(a, a) ** 0.5


def multiply(matrix: DataFrame, v: DataFrame) -> DataFrame:
    """Matrix times vector: a join on the column and a sum by row, partly summed before the shuffle."""
    joined = matrix.join(v.select(F.col("idx").alias("col"), F.col("value").alias("__v")), "col")
    return joined.groupBy(F.col("row").alias("idx")).agg(F.sum(F.col("value") * F.col("__v")).alias("value"))


def conjugate_gradient(apply: Callable[[DataFrame], DataFrame], b: DataFrame, tolerance: float = 1e-10, most: int = 200) -> DataFrame:
    """Solves apply(x) = b for a symmetric positive operator; vectors are staged each step, the driver holds two numbers."""
    x, r = staged(scale(b, 0.0), "x"), staged(b, "r")
    p, rr = r, inner(r, r)
    goal = tolerance**2 * max(rr, 1e-300)
    for _ in range(most):
        if rr <= goal:
            break
        ap = staged(apply(p), "ap")
        step = rr / inner(p, ap)
        x, r = staged(combine(x, p, 1.0, step), "x"), staged(combine(r, ap, 1.0, -step), "r")
        new = inner(r, r)
        p, rr = staged(combine(r, p, 1.0, new / rr), "p"), new
    return x


Solve = Callable[[DataFrame, DataFrame], DataFrame]


def newton(rhs: Callable[[DataFrame], DataFrame], solve: Solve, x0: DataFrame, tolerance: float = 1e-7, most: int = 20) -> tuple[DataFrame, float]:
    """Root of rhs(x): x - solve(x, rhs(x)) until the residual's norm is small; gives x and that norm."""
    x = staged(x0, "newton")
    for _ in range(most):
        f = staged(rhs(x), "rhs")
        size = length(f)
        if size < tolerance:
            return x, size
        x = staged(combine(x, solve(x, f), 1.0, -1.0), "newton")
    return x, length(rhs(x))


def theta_step(rhs: Callable[[DataFrame], DataFrame], solve: Callable[[DataFrame, DataFrame, float], DataFrame], x: DataFrame, dt: float, theta: float = 1.0, tolerance: float = 1e-7) -> DataFrame:
    """One implicit step of dx/dt = rhs(x) by the theta method. ``solve(x, f, c)`` solves (I - c J(x)) d = f."""
    start = staged(combine(x, rhs(x), 1.0, dt * (1 - theta)), "start") if theta < 1 else x

    def residual(y: DataFrame) -> DataFrame:
        return combine(combine(y, start, 1.0, -1.0), rhs(y), 1.0, -dt * theta)

    return newton(residual, lambda y, f: solve(y, f, dt * theta), x, tolerance)[0]


def time_stepper(rhs, solve, x: DataFrame, dt: float, until: float, theta: float = 1.0) -> DataFrame:
    """Steps of ``dt`` until the time is reached; the last may be shorter."""
    t = 0.0
    while t < until - 1e-12 * max(1.0, abs(until)):
        step = min(dt, until - t)
        x, t = theta_step(rhs, solve, x, step, theta), t + step
    return x


def continuation(rhs: Callable[[DataFrame, float], DataFrame], by_parameter: Callable[[DataFrame, float], DataFrame], solve: Callable[[DataFrame, float, DataFrame], DataFrame], x: DataFrame, start: float, target: float, step: float, tolerance: float = 1e-7, most: int = 100) -> tuple[DataFrame, float]:
    """Follows a root from one parameter value to another by pseudo-arclength steps: tangent predictor, bordered Newton corrector.

    ``solve(x, p, f)`` solves J(x, p) d = f. Gives the root at the target, where the last correction keeps the parameter.
    """
    p, ds = start, abs(step)
    sign = 1.0 if target >= start else -1.0
    x = staged(x, "branch")
    for _ in range(most):
        tangent = staged(scale(solve(x, p, by_parameter(x, p)), -1.0), "tangent")
        norm = (1.0 + inner(tangent, tangent)) ** 0.5
        dp = sign / norm
        if sign * (p + ds * dp - target) >= 0:
            x0 = combine(x, tangent, 1.0, target - p)
            return newton(lambda y: rhs(y, target), lambda y, f: solve(y, target, f), x0, tolerance)[0], target
        dx = staged(scale(tangent, dp), "direction")
        y, q = staged(combine(x, dx, 1.0, ds), "branch"), p + ds * dp
        for _ in range(20):
            f = staged(rhs(y, q), "rhs")
            along = inner(dx, combine(y, x, 1.0, -1.0)) + dp * (q - p) - ds
            if length(f) < tolerance and abs(along) < tolerance:
                break
            z1, z2 = staged(solve(y, q, f), "z1"), staged(solve(y, q, by_parameter(y, q)), "z2")
            dq = (inner(dx, z1) - along) / (dp - inner(dx, z2))
            y, q = staged(combine(combine(y, z1, 1.0, -1.0), z2, 1.0, -dq), "branch"), q + dq
        x, p = y, q
    return x, p
