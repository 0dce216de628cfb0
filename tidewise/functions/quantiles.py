"""Exact quantiles (linear interpolation, as pandas ``quantile`` and SQL
``quantile_cont``) and exact order statistics without holding a whole
column in one task.

Spark's exact ``percentile`` keeps every distinct value of a group in one
task's memory; at scale that is an unbounded group. Here each wanted order
statistic (the k-th smallest non-null value of a series) is found by
bracketing:

1. one aggregate job gives, per series (a column under an optional
   predicate), count, smallest and largest value and an approximate quantile
   grid (``percentile_approx``, deterministic rank error n/accuracy);
2. a target whose bracket may hold more than ``LIMIT`` rows is narrowed with
   another grid over the bracket (each pass shrinks it ~200x). A bracket whose
   smallest and largest value agree is the answer, however often the value
   occurs. A bracket that a pass does not halve, or that misses the rank, is
   split at PIVOTS values spaced evenly over the 64-bit order of numbers, with
   exact counts: that shrinks it by PIVOTS whatever the data, so the search
   ends after at most 11 such passes;
3. brackets of at most ``LIMIT`` rows are resolved together, as many as hold
   TOTAL rows: one job explodes each row into the brackets that contain it and
   runs ``groupBy(bracket, value).count()``; the driver receives at most
   ``TOTAL`` (value, count) pairs a job (more are never read: such brackets
   are split instead).

Every bracket is verified (count below <= k < count below + count inside).
All targets of a step share one scan; ties are compressed by the group-by.
"""

from __future__ import annotations

import math
import struct
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRID = 1000
ACCURACY = 20_000
LIMIT = 50_000
TOTAL = 200_000
PIVOTS = 64


@dataclass
class _Target:
    series: int
    k: int
    lo: float | int | None = None
    hi: float | int | None = None
    est: int = 0
    n: int = 0
    value: float | int | None = None
    done: bool = False
    split: bool = False


def _in(c: Column, lo, hi) -> Column:
    return c.isNotNull() & (c >= F.lit(lo)) & (c <= F.lit(hi))


def _below(c: Column, lo) -> Column:
    return c.isNotNull() & (c < F.lit(lo))


def _rank(v: float | int, integral: bool) -> int:
    """The place of a number in the order of all numbers of its type."""
    if integral:
        return v
    bits = struct.unpack(">Q", struct.pack(">d", v))[0]
    return bits ^ (2 ** 64 - 1) if bits >> 63 else bits | 1 << 63


def _value(rank: int, integral: bool) -> float | int:
    if integral:
        return rank
    bits = rank & (2 ** 63 - 1) if rank >> 63 else rank ^ (2 ** 64 - 1)
    return struct.unpack(">d", struct.pack(">Q", bits))[0]


def _widen(v, down: bool, integral: bool):
    pad = 4 * math.ulp(float(v))
    w = float(v) - pad if down else float(v) + pad
    if integral:
        return int(math.floor(w)) if down else int(math.ceil(w))
    return w


def _found(t: _Target, value) -> None:
    t.value, t.done = value, True


def _bracket(t: _Target, grid, below: int, integral: bool, limit: int) -> None:
    """Choose [lo, hi] around rank ``t.k`` from a grid over the current
    bracket (``t.n`` rows inside, ``below`` rows under it)."""
    if t.lo == t.hi:
        return _found(t, t.lo)
    if t.n <= limit or grid is None:
        t.est = t.n
        return
    r = (t.k - below) / max(t.n - 1, 1)
    j_lo, j_hi = math.floor(r * GRID) - 2, math.ceil(r * GRID) + 2
    if j_lo > 0:
        t.lo = max(t.lo, _widen(grid[j_lo], True, integral))
    if j_hi < GRID:
        t.hi = min(t.hi, _widen(grid[j_hi], False, integral))
    span = min(j_hi, GRID) - max(j_lo, 0)
    t.est = min(t.n, int(t.n * span / GRID + 2 * t.n / ACCURACY) + 1)


def _narrow(df, vals, preds, wide, grid_p, integral, limit) -> None:
    aggs = []
    for j, t in enumerate(wide):
        v, p = vals[t.series], preds[t.series]
        inside = F.when(p & _in(v, t.lo, t.hi), v)
        aggs += [F.count_if(p & _below(v, t.lo)).alias(f"b{j}"), F.count(inside).alias(f"n{j}"),
                 F.min(inside).alias(f"x{j}"), F.max(inside).alias(f"y{j}"),
                 F.percentile_approx(inside, grid_p, ACCURACY).alias(f"g{j}")]
    row = df.agg(*aggs).first()
    for j, t in enumerate(wide):
        below, n = row[f"b{j}"], row[f"n{j}"]
        if not below <= t.k < below + n:
            t.split = True  # the grid missed the rank: split the whole series
            continue
        t.split, t.n = n > t.n / 2, n
        t.lo, t.hi = row[f"x{j}"], row[f"y{j}"]
        if t.lo == t.hi:
            _found(t, t.lo)
        elif not t.split:
            _bracket(t, row[f"g{j}"], below, integral, limit)


def _split(df, vals, preds, targets, ends, integral, limit) -> None:
    """Split each bracket at evenly spaced places of the number order; exact
    counts below every pivot tell which part holds the rank."""
    aggs, pivots = [], []
    for j, t in enumerate(targets):
        if not t.n:
            t.lo, t.hi = ends[t.series]
        a, b = _rank(t.lo, integral), _rank(t.hi, integral)
        pivots.append(sorted({a + (b - a + 1) * i // PIVOTS for i in range(1, PIVOTS)} - {a}))
        v, p = vals[t.series], preds[t.series]
        aggs += [F.count_if(p & _below(v, _value(c, integral))).alias(f"c{j}_{i}") for i, c in enumerate(pivots[j])]
        aggs += [F.count_if(p & _below(v, t.lo)).alias(f"b{j}"), F.count_if(p & v.isNotNull() & (v <= F.lit(t.hi))).alias(f"e{j}")]
    row = df.agg(*aggs).first()
    for j, t in enumerate(targets):
        if not row[f"b{j}"] <= t.k < row[f"e{j}"]:
            t.n, t.split = 0, True  # start over from the whole series
            continue
        counts = [row[f"b{j}"], *(row[f"c{j}_{i}"] for i in range(len(pivots[j]))), row[f"e{j}"]]
        edges = [_rank(t.lo, integral), *pivots[j], _rank(t.hi, integral) + 1]
        i = max(i for i in range(len(counts) - 1) if counts[i] <= t.k)
        t.lo, t.hi = _value(edges[i], integral), _value(edges[i + 1] - 1, integral)
        t.n = t.est = counts[i + 1] - counts[i]
        t.split = t.n > limit
        if t.lo == t.hi:
            _found(t, t.lo)


def _resolve(df, vals, preds, narrow, dtype: str, limit: int) -> None:
    """One scan: each row goes to the brackets that hold it (value) or lie
    above it (NULL marker = counted below). Targets of the same series with
    the same bracket share one bracket group."""
    groups: dict[tuple, int] = {}
    members: list[list[_Target]] = []
    held = 0
    for t in narrow:
        key = (t.series, t.lo, t.hi)
        if key not in groups:
            if members and held + t.est > TOTAL:
                continue  # in a later job
            held += t.est
            groups[key] = len(members)
            members.append([])
        members[groups[key]].append(t)
    hits = []
    for (series, lo, hi), j in groups.items():
        v, p = vals[series], preds[series]
        hits.append(F.when(p & _in(v, lo, hi), F.struct(F.lit(j).alias("t"), v.alias("v"))))
        hits.append(F.when(p & _below(v, lo), F.struct(F.lit(j).alias("t"), F.lit(None).cast(dtype).alias("v"))))
    exploded = df.select(F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("h"))
    most = 2 * TOTAL + 2 * len(members)
    counts = (exploded.groupBy(F.col("h.t").alias("t"), F.col("h.v").alias("v"))
              .agg(F.count(F.lit(1)).alias("c")).limit(most + 1).collect())
    if len(counts) > most:  # estimates were far off: exact splits instead
        for ts in members:
            for t in ts:
                t.split = True
        return
    per: dict[int, list] = {}
    for r in counts:
        per.setdefault(r["t"], []).append((r["v"], r["c"]))
    for j, ts in enumerate(members):
        rows = per.get(j, [])
        below = sum(c for v, c in rows if v is None)
        pairs = sorted((v, c) for v, c in rows if v is not None)
        n_in = sum(c for _, c in pairs)
        for t in ts:
            rank = t.k - below
            if not 0 <= rank < n_in:
                t.split, t.n = True, 0
                continue
            acc = 0
            for v, c in pairs:
                acc += c
                if rank < acc:
                    _found(t, v)
                    break


def _solve(df: DataFrame, series, ranks, dtype: str, extra=None, extra_out=None,
           limit: int | None = None):
    """Core: the k-th smallest values per series for ``ranks(i, n)``."""
    limit = limit or LIMIT
    if not series and not extra:
        return []
    integral = dtype in ("bigint", "int", "long", "integer", "smallint", "tinyint")
    # columns of their own, so that a row's values are computed once in a pass
    df = df.withColumns({f"_qv{i}": c.cast(dtype) for i, (c, _) in enumerate(series)}
                        | {f"_qp{i}": p for i, (_, p) in enumerate(series) if p is not None}) if series else df
    vals = [F.col(f"_qv{i}") for i in range(len(series))]
    preds = [F.lit(True) if p is None else F.col(f"_qp{i}") for i, (_, p) in enumerate(series)]
    grid_p = [j / GRID for j in range(GRID + 1)]
    aggs = []
    for i, (v, p) in enumerate(zip(vals, preds)):
        x = F.when(p, v)
        aggs += [F.count(x).alias(f"_qn{i}"), F.min(x).alias(f"_qx{i}"), F.max(x).alias(f"_qy{i}"),
                 F.percentile_approx(x, grid_p, ACCURACY).alias(f"_qg{i}")]
    row = df.agg(*aggs, *(extra or [])).first()
    if extra_out is not None:
        extra_out.update(row.asDict())
    ends = [(row[f"_qx{i}"], row[f"_qy{i}"]) for i in range(len(series))]
    targets: list[_Target] = []
    plan = []
    for i in range(len(series)):
        n, ids = row[f"_qn{i}"], []
        for k in ranks(i, n):
            if k is None or not 0 <= k < n:
                ids.append(None)
                continue
            t = _Target(series=i, k=k, lo=ends[i][0], hi=ends[i][1], n=n)
            _bracket(t, row[f"_qg{i}"], 0, integral, limit)
            targets.append(t)
            ids.append(len(targets) - 1)
        plan.append(ids)
    while any(not t.done for t in targets):
        split = [t for t in targets if not t.done and t.split]
        if split:
            _split(df, vals, preds, split[:PIVOTS], ends, integral, limit)
        wide = [t for t in targets if not t.done and not t.split and t.est > limit]
        if wide:
            _narrow(df, vals, preds, wide, grid_p, integral, limit)
        narrow = [t for t in targets if not t.done and not t.split and t.est <= limit]
        if narrow:
            _resolve(df, vals, preds, narrow, dtype, limit)
    return [[targets[j].value if j is not None else None for j in ids] for ids in plan]


def quantiles(df: DataFrame, series: list[tuple[Column, Column | None]],
              probs: list[list[float]], limit: int | None = None,
              extra: list[Column] | None = None, extra_out: dict | None = None) -> list[list[float | None]]:
    """``series[i] = (value expression, predicate or None)``; returns, for
    each series, the exact interpolated quantile at each of ``probs[i]``
    (NULL when the series is empty). ``extra`` aggregates ride along in the
    first pass; their values are put into ``extra_out``."""
    positions: dict[int, list[tuple[int, int, float]]] = {}

    def ranks(i, n):
        out, pos = [], []
        for q in probs[i]:
            if n == 0:
                pos.append(None)
                continue
            h = (n - 1) * q
            k0, k1 = math.floor(h), math.ceil(h)
            pos.append((len(out), len(out) + 1, h - k0))
            out += [k0, k1]
        positions[i] = pos
        return out

    values = _solve(df, series, ranks, "double", extra, extra_out, limit)
    result = []
    for i, vals in enumerate(values):
        res = []
        for item in positions.get(i, []):
            if item is None:
                res.append(None)
                continue
            a, b, frac = vals[item[0]], vals[item[1]], item[2]
            res.append(a + frac * (b - a) if frac else a)
        result.append(res)
    return result


def order_statistics(df: DataFrame, series: list[tuple[Column, Column | None]],
                     ranks, dtype: str = "double", limit: int | None = None) -> list[list[float | int | None]]:
    """The k-th smallest value (0-based) of each series for the ranks that
    ``ranks(i, n)`` returns once the series' count ``n`` is known. Values
    keep ``dtype`` throughout (use ``bigint`` for exact 64-bit keys)."""
    return _solve(df, series, ranks, dtype, limit=limit)


def quantile(df: DataFrame, col: str | Column, q: float, where: Column | None = None) -> float | None:
    c = F.col(col) if isinstance(col, str) else col
    return quantiles(df, [(c, where)], [[q]])[0][0]
