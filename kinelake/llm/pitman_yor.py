"""Pitman-Yor restaurants: seating sampled by Gibbs, with random numbers that belong to the dish.

A restaurant serves dishes; its customers sit at tables, one dish a table, and each table
is a customer of the parent restaurant. For a dish with c customers at t tables

    P(dish) = (c - d t) / (theta + C) + (theta + d T) / (theta + C) * P_parent(dish)

with C and T summed over the restaurant. Given one gamma variable a restaurant,
g ~ Gamma(theta / d + T), its dishes are independent: the seating of a dish has the
probability z^t times (1 - d)(2 - d)... over the sizes of its tables, z = d g P_parent(dish).

A Gibbs update takes all customers of a dish away and seats them again by this conditional,
z^t S(c, t) with generalised Stirling numbers S. Up to TABULATED customers these are a table,
and the draw is exact. Beyond, S(c, t) = c! / (t! d^t) times the chance that t tables of
Sibuya(d) sizes hold c customers in all, which is a contour integral around the branch cut
of the sizes' generating function, summed at NODES points of a path through the saddle point
(`log_chance`: eight digits, two where a single table holds 10^9 customers and d is near 1). Numbers of tables are proposed from a mixture of two
logistic laws, around the saddle point of the joint law of tables and customers and around the
number that there would be without the condition on the customers, and taken by
Metropolis and Hastings' rule (TRIES times a sweep). The state is the number of tables alone,
and the cost of a proposal does not depend on the number of customers.

All random numbers are hashes of (dish, sweep, position): results depend neither on
how dishes are dealt to tasks nor on their order.
"""

from __future__ import annotations

import numpy as np

THETA = 1.0
TABULATED, TRIES = 512, 3
NODES, SPAN, BEND = 96, 10.0, 0.5
_CELLS = 1 << 21


def discount(ones: float, twos: float) -> float:
    """The usual estimate n1 / (n1 + 2 n2) from how many dishes have one and two customers, kept within (0, 1)."""
    return float(np.clip((ones + 0.5) / (ones + 2.0 * twos + 1.0), 0.05, 0.95))


def mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser: a bijection of 64-bit numbers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, stream: int, position) -> np.ndarray:
    """Numbers within (0, 1) for 64-bit keys, a stream and positions in it."""
    step = np.atleast_1d(np.asarray(position, np.uint64)) * np.uint64(0x9E3779B97F4A7C15) + np.uint64((stream * 0xD1B54A32D192ED03) % 2**64)
    return ((mixed(mixed(key + np.uint64(0x632BE59BD9B4E019)) ^ mixed(step)) >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def log_gamma(x: np.ndarray) -> np.ndarray:
    """log of the gamma function for x > 0 (Stirling's series eight places up)."""
    y = x + 8.0
    inverse = 1.0 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    low = x * (x + 1) * (x + 2) * (x + 3)
    high = (x + 4) * (x + 5) * (x + 6) * (x + 7)
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + series - np.log(low) - np.log(high)


def gamma(key: np.ndarray, stream: int, shape: np.ndarray) -> np.ndarray:
    """Gamma variables with shapes over 1/3 (Marsaglia and Tsang's rejection), by key."""
    a = shape - 1 / 3
    b = 1 / np.sqrt(9 * a)
    out, left, turn = np.zeros(len(shape)), np.arange(len(shape)), 0
    while len(left):
        u = [uniform(key[left], stream, 3 * turn + i) for i in range(3)]
        x = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])
        v = (1 + b[left] * x) ** 3
        good = v > 0
        good[good] = np.log(u[2][good]) < x[good] ** 2 / 2 + a[left][good] * (1 - v[good] + np.log(v[good]))
        out[left[good]] = a[left[good]] * v[good]
        left, turn = left[~good], turn + 1
    return out


_TABLES: dict[tuple[float, int], np.ndarray] = {}


def stirling(d: float, most: int) -> np.ndarray:
    """log S(c, t) for c, t up to `most`: the weights of all seatings of c customers at t tables."""
    known = _TABLES.get((d, most))
    if known is not None:
        return known
    _TABLES.clear()
    out = _TABLES[d, most] = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    t = np.arange(1, most + 1)
    with np.errstate(divide="ignore"):
        for n in range(1, most):
            joins = np.log(np.maximum(n - d * t, 0.0)) + out[n, 1:]
            out[n + 1, 1:] = np.logaddexp(out[n, :-1], joins)
    return out


def _from_table(key: np.ndarray, sweep: int, c: int, z: np.ndarray, d: float) -> np.ndarray:
    """Tables of dishes with c customers each, drawn from the conditional z^t S(c, t)."""
    t = np.arange(1, c + 1)
    logs = stirling(d, TABULATED)[c, 1 : c + 1] + np.log(np.maximum(z, 1e-300))[:, None] * t
    running = np.cumsum(np.exp(logs - logs.max(axis=1, keepdims=True)), axis=1)
    return 1 + (running[:, :-1] < (uniform(key, sweep, 0) * running[:, -1])[:, None]).sum(axis=1)


def _solved(low: float, high: float, under) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, 1 - x and log(1 - x) where under(x, 1 - x, log(1 - x)) turns from true to false, by halving log(x / (1 - x))."""

    def of(m):
        x, rest = np.exp(-np.logaddexp(0, -m)), np.exp(-np.logaddexp(0, m))
        return x, rest, np.where(m > 0, -np.logaddexp(0, m), np.log1p(-np.minimum(x, 0.6)))

    for _ in range(64):
        m = (low + high) / 2
        up = under(*of(m))
        low, high = np.where(up, m, low), np.where(up, high, m)
    return of((low + high) / 2)


def _log1p(x: np.ndarray) -> np.ndarray:
    """log(1 + x) of complex numbers, precise for small ones too (counts multiply its error)."""
    return 0.5 * np.log1p(x.real * (2 + x.real) + x.imag**2) + 1j * np.arctan2(x.imag, 1 + x.real)


def log_chance(count: np.ndarray, tables: np.ndarray, d: float) -> np.ndarray:
    """log of the probability that `tables` independent tables of Sibuya(d) sizes have `count` customers in all.

    The coefficient of x^count in (1 - (1 - x)^d)^tables: its integral over a hyperbola
    that crosses the real axis at the saddle point (not nearer than 1 / count to the branch
    point at 1) and bends towards the side on which the integrand falls. For counts of some
    hundred and more: below, the path is cut off too early for d near 1.
    """
    if len(count) > 2048:
        parts = range(0, len(count), 2048)
        return np.concatenate([log_chance(count[i : i + 2048], tables[i : i + 2048], d) for i in parts])
    c, t = count.astype(float), tables.astype(float)
    x, rest, _ = _solved(np.full(len(c), -60.0), np.full(len(c), 60.0), lambda x, q, lq: t * d * x * np.exp((d - 1) * lq) < (c + 0.5) * -np.expm1(d * lq))
    close = rest < 1 / c
    x, rest = np.where(close, 1 - 1 / c, x), np.where(close, 1 / c, rest)
    near = rest < 0.5
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        log_rest, log_x = np.where(near, np.log(rest), np.log1p(-x)), np.where(near, np.log1p(-rest), np.log(x))
        f = -np.expm1(d * log_rest)
        # Ratios of derivatives to f; second and third derivatives of the integrand's logarithm.
        one = d * np.exp((d - 1) * log_rest) / f
        two = one * (1 - d) / rest
        three = two * (2 - d) / rest
        second = t * (two - one**2) + (c + 1) / x**2
        third = t * (three - 3 * one * two + 2 * one**3) - 2 * (c + 1) / x**3
        width = np.where(close, rest, 1 / np.sqrt(second))[:, None]
        bend = np.where(close | (third > 0), BEND, -BEND)[:, None]
        u = (np.arange(NODES) + 0.5) * (SPAN / NODES)
        step = width * ((np.cosh(u) - 1) * np.sin(bend) + 1j * np.sinh(u) * np.cos(bend))
        slope = width * (np.sinh(u) * np.sin(bend) + 1j * np.cosh(u) * np.cos(bend))
        right, left, near = x[:, None] + step, rest[:, None] - step, near[:, None]
        log_left, log_right = np.where(near, np.log(left), _log1p(-right)), np.where(near, _log1p(-left), np.log(right))
        ratio = t[:, None] * np.log(-np.expm1(d * log_left) / f[:, None]) - (c[:, None] + 1) * (log_right - log_x[:, None])
        area = (np.exp(ratio) * slope).imag.sum(axis=1) * (SPAN / NODES / np.pi)
        return t * np.log(f) - (c + 1) * log_x + np.log(area)


def log_weight(count: np.ndarray, tables: np.ndarray, z: np.ndarray, d: float) -> np.ndarray:
    """log of z^t S(c, t) / c!"""
    return tables * np.log(z / d) - log_gamma(tables + 1.0) + log_chance(count, tables, d)


def _centres(count: np.ndarray, z: np.ndarray, d: float) -> tuple[np.ndarray, np.ndarray]:
    """Middles and scales, shaped (2, dishes), of the two logistic laws that proposals come from."""
    c = count.astype(float)
    x, rest, log_rest = _solved(np.full(len(c), -60.0), np.full(len(c), 600.0), lambda x, q, lq: np.log(z) + np.log(x) + (d - 1) * lq < np.log(c))
    # Poisson(z / d) tables of sizes tilted to the sum c: given the sum, the variance of their number is less.
    free, mean = z / d, z / d * -np.expm1(d * log_rest)
    ratio = x * (1 - d) / np.maximum(rest, 1e-300)
    spread = np.maximum(mean - c / (1 + ratio), 0.0)
    middle = np.clip([mean, free + 1], 1.0, c)
    return middle, 0.6 * np.sqrt([spread, np.minimum(free, c)]) + 0.5


def _proposal(tables: np.ndarray, count: np.ndarray, middle: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """log of the probability that a number of tables is proposed (constants left out)."""
    total = 0.0
    for m, s in zip(middle, scale, strict=True):
        low, high = _logistic((0.5 - m) / s), _logistic((count + 0.5 - m) / s)
        far = np.clip((tables - m) / s, -600, 600)
        total = total + np.sinh(0.5 / s) / (np.cosh(far) + np.cosh(0.5 / s)) / (high - low)
    return np.log(np.maximum(total, 1e-300))


def _logistic(x: np.ndarray) -> np.ndarray:
    return np.exp(-np.logaddexp(0, -x))


def _by_weights(key: np.ndarray, sweep: int, count: np.ndarray, z: np.ndarray, d: float, tables: np.ndarray) -> np.ndarray:
    """Update dishes with many customers, from their present numbers of tables (0: none yet)."""
    z = np.maximum(z, 1e-290)
    middle, scale = _centres(count, z, d)
    tables = np.where(tables > 0, np.clip(tables, 1, count), np.rint(middle[0]).astype(np.int64))
    now = log_weight(count, tables, z, d) - _proposal(tables, count, middle, scale)
    for turn in range(TRIES):
        which, place, chance = (uniform(key, -2 - sweep * TRIES - turn, k) for k in range(3))
        m, s = (np.where(which < 0.5, x[0], x[1]) for x in (middle, scale))
        low, high = _logistic((0.5 - m) / s), _logistic((count + 0.5 - m) / s)
        p = low + place * (high - low)
        new = np.clip(np.rint(m + s * (np.log(p) - np.log1p(-p))), 1, count).astype(np.int64)
        then = log_weight(count, new, z, d) - _proposal(new, count, middle, scale)
        good = np.log(chance) < then - now
        tables, now = np.where(good, new, tables), np.where(good, then, now)
    return tables


def reseat(key: np.ndarray, sweep: int, count: np.ndarray, z: np.ndarray, d: float, tables: np.ndarray) -> np.ndarray:
    """A Gibbs update of each dish: its new number of tables, given the present one (0: no seating yet)."""
    out = np.minimum(count, 1)
    few = np.flatnonzero((count > 1) & (count <= TABULATED))
    few = few[np.argsort(count[few], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], count[few][1:] != count[few][:-1], [True]])) if len(few) else [0]
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        c = int(count[few[i]])
        for k in range(i, j, max(1, _CELLS // c)):
            own = few[k : min(j, k + max(1, _CELLS // c))]
            out[own] = _from_table(key[own], sweep, c, z[own], d)
    many = np.flatnonzero(count > TABULATED)
    if len(many):
        out[many] = _by_weights(key[many], sweep, count[many], z[many], d, tables[many])
    return out


def predictive(count, tables, total, total_tables, d, theta, parent):
    """P(dish) from its customers and tables, the restaurant's totals and the parent's P."""
    return (count - d * tables + (theta + d * total_tables) * parent) / (theta + total)
