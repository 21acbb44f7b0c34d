"""Oracle SQL as a chain of projections: each ``add`` is one common table expression."""

from __future__ import annotations


def rows(w: int) -> str:
    return f"(PARTITION BY entity ORDER BY date ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"


E = "(PARTITION BY entity ORDER BY date)"
D = "(PARTITION BY date)"


def roll(agg: str, x: str, w: int, least: int | None = None) -> str:
    """``agg`` is a template with {x}."""
    k = max(2, w // 2) if least is None else least
    return f"CASE WHEN count({x}) OVER {rows(w)} >= {k} THEN {agg.format(x=x)} OVER {rows(w)} END"


def mean(x, w, k=None):
    return roll("avg({x})", x, w, k)


def tsum(x, w, k=None):
    return roll("sum({x})", x, w, k)


def std(x, w, k=None):
    return roll("stddev_samp({x})", x, w, k)


def var(x, w, k=None):
    return roll("var_samp({x})", x, w, k)


def tmax(x, w, k=None):
    return roll("max({x})", x, w, k)


def tmin(x, w, k=None):
    return roll("min({x})", x, w, k)


def med(x, w, k=None):
    return roll("quantile_cont({x}, 0.5)", x, w, k)


def skew(x, w, k=None):
    return roll("skewness({x})", x, w, max(3, max(2, w // 2) if k is None else k))


def zs(x, w):
    return f"({x} - {mean(x, w)}) / nullif({std(x, w)}, 0)"


def lag(x, n=1):
    return f"lag({x}, {n}) OVER {E}"


class Chain:
    def __init__(self, prefix: str, source: str, tag: str = "s"):
        self.prefix, self.source, self.tag, self.n = prefix, source, tag, 0

    def add(self, **cols) -> Chain:
        name = f"{self.tag}{self.n}"
        body = ", ".join(f"{e} AS {c}" for c, e in cols.items())
        self.prefix += f",\n{name} AS (SELECT *, {body} FROM {self.source})"
        self.source, self.n = name, self.n + 1
        return self

    def corr(self, out: str, a: str, b: str, w: int, k: int | None = None) -> Chain:
        k = max(2, max(2, w // 2) if k is None else k)
        x, y = f"{out}_x", f"{out}_y"
        self.add(**{x: f"CASE WHEN {b} IS NOT NULL THEN {a} END", y: f"CASE WHEN {a} IS NOT NULL THEN {b} END"})
        f = rows(w)
        return self.add(**{out: f"CASE WHEN count({x}) OVER {f} >= {k} AND max({x}) OVER {f} > min({x}) OVER {f} "
                                f"AND max({y}) OVER {f} > min({y}) OVER {f} THEN corr({x}, {y}) OVER {f} END"})

    def rank01(self, out: str, x: str) -> Chain:
        d = f"{out}_d"
        self.add(**{d: f"CASE WHEN {x} IS NOT NULL THEN dense_rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) END"})
        return self.add(**{out: f"({d} - 1.0) / nullif(max({d}) OVER {D} - 1, 0)"})

    def pct(self, out: str, x: str) -> Chain:
        return self.add(**{out: f"CASE WHEN {x} IS NOT NULL THEN (rank() OVER (PARTITION BY date ORDER BY {x} NULLS LAST) "
                                f"+ (count(*) OVER (PARTITION BY date, {x}) - 1) / 2.0) / count({x}) OVER {D} END"})

    def unit(self, out: str, x: str, by: str = "date") -> Chain:
        n = f"count({x}) OVER (PARTITION BY {by})"
        return self.add(**{out: f"CASE WHEN {x} IS NULL THEN NULL WHEN {n} = 1 THEN 0 ELSE 2 * (rank() OVER (PARTITION BY {by} ORDER BY {x} NULLS LAST) "
                                f"+ (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2.0 - 1) / nullif({n} - 1, 0) - 1 END"})

    def winsor(self, out: str, x: str, p: float) -> Chain:
        return self.add(**{out: f"CASE WHEN {x} IS NOT NULL THEN greatest(least({x}, quantile_cont({x}, {1 - p}) OVER {D}), "
                                f"quantile_cont({x}, {p}) OVER {D}) END"})

    def final(self, core: str, p: float, weight: str = "1") -> Chain:
        return self.winsor("core_w", core, p).add(alpha=f"nullif(core_w * ({weight}), 0)")
