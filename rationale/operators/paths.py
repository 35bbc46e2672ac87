"""Least-angle paths from moments, with a test of every choice."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rationale.functions.small import MOST_ROWS, apart
from rationale.sources.scratch import stored

from .linear import centred, moments

_STEP = "array<struct<step:int,penalty:double,entered:int,dropped:int,runner_up:int,coef:array<double>>>"


def homotopy(xx: np.ndarray, xy: np.ndarray, lasso: bool = True) -> list[tuple]:
    """Breakpoints of the path: (penalty, entered, dropped, runner-up, coefficients), from no features to least squares.

    Between two of them the coefficients of the active features move so that all
    their correlations with the residual fall alike.  A breakpoint is where a feature
    outside comes level with them and enters, or (lasso) where an active one passes 0
    and is dropped.  Features that are sums of active ones never enter; ties go to the
    first.  The runner-up is the feature outside that is next to the entered one.
    """
    p = len(xy)
    coef, active, signs = np.zeros(p), [], {}
    scale = max(float(np.abs(xy).max(initial=0.0)), 1e-300)
    tiny = 1e-10
    closed = {j for j in range(p) if xx[j, j] <= tiny * max(float(np.diag(xx).max(initial=0.0)), 1e-300)}
    out: list[tuple] = []
    level, dropped = float(max((abs(xy[j]) for j in range(p) if j not in closed), default=0.0)), None
    if level <= tiny * scale:
        return [(0.0, None, None, None, coef.copy())]
    while True:
        if len(out) > 64 * (p + 1):
            raise ArithmeticError("the path goes round in circles")
        c = xy - xx @ coef
        entered = runner_up = None
        outside = sorted((j for j in range(p) if j not in active and j not in closed and j != dropped), key=lambda j: (-round(abs(c[j]) / scale, 12), j))
        if level > tiny * scale and outside and abs(c[outside[0]]) >= level - 1e-9 * scale:
            j = outside[0]
            own = xx[np.ix_(active, active)]
            rest = xx[j, j] - (xx[j, active] @ np.linalg.solve(own, xx[active, j]) if active else 0.0)
            if rest <= tiny * xx[j, j]:
                closed.add(j)
                continue
            entered, runner_up = j, outside[1] if len(outside) > 1 else None
            active.append(j)
            signs[j] = np.sign(c[j])
        out.append((level, entered, dropped, runner_up, coef.copy()))
        if level <= tiny * scale:
            return out
        step = np.zeros(p)
        step[active] = np.linalg.solve(xx[np.ix_(active, active)], [signs[j] for j in active]) if active else []
        fall = xx @ step
        moves = [(level, -1, None)]
        for j in range(p):
            if j in active or j in closed:
                continue
            for sign in (1, -1):
                if 1 - sign * fall[j] > 1e-12:
                    move = (level - sign * c[j]) / (1 - sign * fall[j])
                    if move > 1e-9 * scale or (j != dropped and move > -1e-9 * scale):
                        moves.append((max(move, 0.0), j, None))
        if lasso:
            moves += [(-coef[j] / step[j], j, j) for j in active if coef[j] * step[j] < 0]
        move, _, leaving = min(moves, key=lambda m: (m[0], m[2] is None, m[1]))
        move = min(move, level)
        coef += move * step
        level = level - move if move < level else 0.0
        dropped = None
        if leaving is not None and level > 0:
            active.remove(leaving)
            coef[leaving], dropped = 0.0, leaving


def angle_path(neigh: DataFrame, keys: list[str], features: list[str], y: str, w: str, method: str = "lasso") -> DataFrame:
    """(keys..., step, penalty, entered, dropped, runner_up, coef_<feature>...): one row for each breakpoint.

    Every neighbourhood's path is solved from its weighted moments; ``penalty`` is the
    correlation with the residual over the number of rows, the lasso's alpha.  A
    neighbourhood without weight has no path.
    """
    p = len(features)

    @F.pandas_udf(_STEP)
    def solved(m: pd.Series, n: pd.Series) -> pd.Series:
        _, _, _, xx, xy, _ = centred(np.array(m.tolist()), p)
        none = lambda v: None if v is None else int(v)
        return pd.Series([[{"step": k, "penalty": float(lam / n.iloc[i]), "entered": none(e), "dropped": none(d), "runner_up": none(r), "coef": coef.tolist()} for k, (lam, e, d, r, coef) in enumerate(homotopy(xx[i], xy[i], method == "lasso"))] for i in range(len(m))])

    counts = neigh.groupBy(*keys).agg(F.count("*").alias("r_n"))
    packed = moments(neigh, keys, features, y, w).where(F.col("m")[0] > 0).join(counts.hint("merge"), keys)
    steps = packed.select(*keys, F.inline(solved("m", "r_n")))
    names = F.array(*[F.lit(f) for f in features])
    named = [F.get(names, F.col(c)).alias(c) for c in ("entered", "dropped", "runner_up")]
    return steps.select(*keys, "step", "penalty", *named, *[F.col("coef")[i].alias(f"coef_{f}") for i, f in enumerate(features)])


def _of(name: str, values: dict[str, Column]) -> Column:
    return F.coalesce(*[F.when(F.col(name) == f, x) for f, x in values.items()])


def tested_path(neigh: DataFrame, keys: list[str], features: list[str], y: str, w: str, method: str = "lasso", z_alpha: float = 1.6448536269514722) -> DataFrame:
    """The path with n, statistic, stable and suggested at every step: is what entered told from its runner-up?

    The statistic is the difference of their absolute correlations with the residual
    of the step, over the deviation that the difference between two samples would have
    (twice the variance of the rows' products over n).  Below ``z_alpha`` the choice
    isn't stable, and so many rows are suggested that it would be.  A step without a
    runner-up is stable.  One aggregate over rows and steps.
    """
    path = stored(angle_path(neigh, keys, features, y, w, method))
    n = path.limit(MOST_ROWS + 1).count()
    wt = F.col(w).cast("double")
    means = neigh.groupBy(*keys).agg((F.sum(wt * F.col(y)) / F.sum(wt)).alias("r_my"), *[(F.sum(wt * F.col(f)) / F.sum(wt)).alias(f"r_m_{f}") for f in features])
    asked = path.where("entered is not null and runner_up is not null").join(apart(means, n), keys)
    rows = neigh.select(*keys, wt.alias("r_w"), F.col(y).cast("double").alias("r_y"), *[F.col(f).cast("double").alias(f"r_x_{f}") for f in features]).join(apart(asked, n, "shuffle_hash"), keys)
    x = {f: F.col(f"r_x_{f}") - F.col(f"r_m_{f}") for f in features}
    residual = F.col("r_y") - F.col("r_my") - sum((x[f] * F.col(f"coef_{f}") for f in features), F.lit(0.0))
    products = rows.select(*keys, "step", (F.col("r_w") * _of("entered", x) * residual).alias("a"), (F.col("r_w") * _of("runner_up", x) * residual).alias("b"))
    sums = products.groupBy(*keys, "step").agg(F.count("*").alias("n"), F.avg("a").alias("ma"), F.avg("b").alias("mb"), F.var_samp("a").alias("va"), F.var_samp("b").alias("vb"), F.covar_samp("a", "b").alias("cab"))
    same = F.when(F.col("ma") * F.col("mb") >= 0, 1.0).otherwise(-1.0)  # of the direction of both
    spread = F.sqrt(F.greatest(2 * (F.col("va") + F.col("vb") - 2 * same * F.col("cab")), F.lit(0.0)) / F.col("n"))
    statistic = (F.abs("ma") - F.abs("mb")) / F.nullif(spread, F.lit(0.0))
    tests = sums.select(*keys, "step", "n", statistic.alias("statistic"))
    stable = F.coalesce(F.col("statistic") >= z_alpha, F.lit(True))
    suggested = F.when(~stable, F.ceil(F.col("n") * F.pow(F.lit(z_alpha) / F.greatest("statistic", F.lit(1e-3)), F.lit(2.0)))).otherwise(F.col("n")).cast("long")
    return path.join(apart(tests, n), [*keys, "step"], "left").select(*path.columns, "n", "statistic", stable.alias("stable"), suggested.alias("suggested"))
