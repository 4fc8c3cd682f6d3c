"""Functions on counts, and numpy versions of special functions and optimisers."""

from __future__ import annotations

import math
from collections.abc import Callable, Generator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rising factorials of longer counts use Stirling's series instead of a sum.
LONG = 1000


def _stirling(x: Column) -> Column:
    """lgamma(x) for x >= LONG."""
    return (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x)


def log_rising(n: Column, a: Column) -> Column:
    """lgamma(n + a) - lgamma(a) for a whole number n >= 0: the sum of ln(a + i) for i < n."""
    n = n.cast("int")
    first = F.least(n, F.lit(LONG))
    head = F.aggregate(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + F.log(a + i))
    return F.when(n <= 0, 0.0).when(n <= LONG, head).otherwise(head + _stirling(n + a) - _stirling(a + LONG))


def digamma_rising(n: Column, a: Column) -> Column:
    """digamma(n + a) - digamma(a) for a whole number n >= 0: the sum of 1 / (a + i) for i < n."""
    n = n.cast("int")
    first = F.least(n, F.lit(LONG))
    head = F.aggregate(F.sequence(F.lit(0), F.greatest(first - 1, F.lit(0))), F.lit(0.0), lambda s, i: s + 1 / (a + i))

    def series(x: Column) -> Column:
        return F.log(x) - 1 / (2 * x) - 1 / (12 * x * x)

    return F.when(n <= 0, 0.0).when(n <= LONG, head).otherwise(head + series(n + a) - series(a + LONG))


def legendre(x: Column, degree: int) -> Column:
    """Shifted Legendre polynomial of the degree at x in [0, 1]: sum of (-1)^(n+j) C(n,j) C(n+j,j) x^j."""
    out = F.lit(0.0)
    for j in reversed(range(degree + 1)):
        out = out * x + float((-1) ** (degree + j) * math.comb(degree, j) * math.comb(degree + j, j))
    return out


def legendre_values(x: np.ndarray, degree: int) -> np.ndarray:
    return np.polyval([(-1) ** (degree + j) * math.comb(degree, j) * math.comb(degree + j, j) for j in reversed(range(degree + 1))], x)


def lgamma(x: np.ndarray) -> np.ndarray:
    """By recurrence up to 8 and Stirling's series."""
    x = np.asarray(x, float)
    shift = np.zeros_like(x)
    y = x.copy()
    for _ in range(8):
        low = y < 8
        shift = shift + np.where(low, np.log(np.where(low, y, 1.0)), 0)
        y = np.where(low, y + 1, y)
    i = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - i * (1 / 360 - i * (1 / 1260 - i * (1 / 1680 - i * (1 / 1188 - i * 691 / 360360))))) / y - shift


def digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    out, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        low = y < 8
        out = out - np.where(low, 1 / np.where(low, y, 1.0), 0)
        y = np.where(low, y + 1, y)
    i = 1 / (y * y)
    return out + np.log(y) - 0.5 / y - i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i / 240)))


def lbfgs_steps(x: np.ndarray, *, steps: int = 10, memory: int = 8) -> Generator[np.ndarray, tuple[float, np.ndarray], tuple[float, np.ndarray]]:
    """Limited-memory BFGS with backtracking as a coroutine: yields points to evaluate, is sent value
    and gradient, and returns the least value and its point. So the points that several minimisations
    ask for can be evaluated in one pass over the data."""
    value, g = yield x
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        q, saved = g.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (s @ y)
            q -= a * y
            saved.append(a)
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        else:
            q /= max(1.0, np.abs(q).max())
        for (s, y), a in zip(pairs, reversed(saved)):
            q += (a - (y @ q) / (s @ y)) * s
        size, slope = 1.0, g @ q
        for _ in range(12):
            new = x - size * q
            new_value, new_g = yield new
            if np.isfinite(new_value) and new_value <= value - 1e-4 * size * slope:
                break
            size /= 2
        else:
            return value, x
        s, y = new - x, new_g - g
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-memory:]
        done = abs(value - new_value) <= 1e-9 * (1 + abs(value))
        x, value, g = new, new_value, new_g
        if done:
            break
    return value, x


def lbfgs(f: Callable[[list[np.ndarray]], list[tuple[float, np.ndarray]]], starts: list[np.ndarray], *, steps: int = 10) -> np.ndarray:
    """The best minimum of f found from any of the starts; f gives values and gradients of several
    points at once, of all starts that go on."""
    running = {i: lbfgs_steps(x, steps=steps) for i, x in enumerate(starts)}
    asked = {i: next(r) for i, r in running.items()}
    ended: list[tuple[float, np.ndarray]] = []
    while asked:
        got = dict(zip(asked, f(list(asked.values()))))
        asked = {}
        for i, answer in got.items():
            try:
                asked[i] = running[i].send(answer)
            except StopIteration as e:
                ended.append(e.value)
    return min(ended, key=lambda e: e[0] if np.isfinite(e[0]) else np.inf)[1]
