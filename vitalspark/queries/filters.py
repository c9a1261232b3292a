"""The band-pass of the signal queries stated in SQL, as a recursion of its own."""

from __future__ import annotations

import math

import numpy as np


def recursion(low: float, high: float, fps: float) -> tuple[list[float], list[float]]:
    """Numerator and denominator of the band-pass of four poles a side, as a recursion: zeros at both ends of the spectrum, poles of the prototype taken to the band, a gain of one at its centre."""
    lo, hi = math.tan(math.pi * low / fps), math.tan(math.pi * high / fps)
    poles = []
    for k in range(4):
        angle = math.pi * (2 * k + 5) / 8
        p = complex(math.cos(angle), math.sin(angle)) * (hi - lo)
        for sign in (1, -1):
            s = (p + sign * (p * p - 4 * lo * hi) ** 0.5) / 2
            poles.append((1 + s) / (1 - s))
    a = np.real(np.poly(poles))
    b = np.array([1.0, 0, -4, 0, 6, 0, -4, 0, 1])
    z = np.exp(-2j * math.atan(math.sqrt(lo * hi)) * np.arange(9))
    return (b * abs((a * z).sum() / (b * z).sum())).tolist(), a.tolist()


def filtered_sql(source: str, keys: str, low: float = 0.7, high: float = 3.5, fps: float = 8.0) -> str:
    """CTEs that take `source` (keys, n, i, x) to `filtered` (keys, i, x): the recursion run forth and back, after an odd extension by 27 samples and from the state of a constant signal."""
    b, a = recursion(low, high, fps)
    steady = [sum(b[k:]) for k in range(1, 9)]  # the answer to a constant is zero, so only the numerator is left
    join = " AND ".join(f"f.{k} = e.{k}" for k in keys.split(", "))
    fk, ek = ", ".join(f"f.{k}" for k in keys.split(", ")), ", ".join(f"e.{k}" for k in keys.split(", "))

    def run(name: str, given: str) -> str:
        first = f"({b[0]!r}::double * x + {steady[0]!r}::double * x)"
        y = f"({b[0]!r}::double * e.x + f.z1)"
        after = lambda v, out, k, z: f"{b[k]!r}::double * {v} - {a[k]!r}::double * {out} + {z}"
        start = ", ".join(after("x", first, k, f"{steady[k]!r}::double * x" if k < 8 else "0") + f" AS z{k}" for k in range(1, 9))
        step = ", ".join(after("e.x", y, k, f"f.z{k + 1}" if k < 8 else "0") for k in range(1, 9))
        return f"{name} AS (SELECT {keys}, n, i, {first} AS y, {start} FROM {given} WHERE i = 0 UNION ALL SELECT {fk}, f.n, e.i, {y}, {step} FROM {name} f JOIN {given} e ON {join} AND e.i = f.i + 1)"

    return f"""o AS MATERIALIZED (SELECT {keys}, n, t::int AS i, t - 27 AS k, CASE WHEN t < 27 THEN 27 - t WHEN t - 27 >= n THEN 2 * n - 2 - (t - 27) ELSE t - 27 END AS at FROM (SELECT DISTINCT {keys}, n FROM {source}) q, range(118) r(t) WHERE t < n + 54),
 r AS (SELECT {keys}, max(x) FILTER (i = 0) AS head, max(x) FILTER (i = n - 1) AS tail FROM {source} GROUP BY {keys}),
 ahead AS MATERIALIZED (SELECT {ek}, e.n, e.i, CASE WHEN e.k < 0 THEN 2 * head - f.x WHEN e.k >= e.n THEN 2 * tail - f.x ELSE f.x END AS x FROM o e JOIN {source} f ON {join} AND f.i = e.at JOIN r ON {' AND '.join(f'r.{k} = e.{k}' for k in keys.split(', '))}),
 {run('forth', 'ahead')}, turned AS MATERIALIZED (SELECT {keys}, n, (n + 53 - i)::int AS i, y AS x FROM forth), {run('back', 'turned')},
 filtered AS (SELECT {keys}, (n + 26 - i)::int AS i, y AS x FROM back WHERE n + 26 - i BETWEEN 0 AND n - 1)"""
