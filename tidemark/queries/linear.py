"""SQL of the closed-form ridge and of the best single split, so that DuckDB can check fitted models.

A chain of common table expressions turns means and covariances into coefficients by a
Cholesky factorisation of the scaled, penalised normal equations.
"""

from __future__ import annotations

from collections.abc import Sequence


def gram_sql(columns: Sequence[str], window: str = "") -> str:
    """Select-list with n, means and covariances of the columns; ``window`` makes them running."""
    over = f" OVER {window}" if window else ""
    parts = [f"CAST(count(*){over} AS DOUBLE) AS n"]
    parts += [f"avg({c}){over} AS s{i}" for i, c in enumerate(columns)]
    for i, a in enumerate(columns):
        parts += [f"covar_pop({a}, {columns[j]}){over} AS g{i}_{j}" for j in range(i, len(columns))]
    return ", ".join(parts)


def _g(i: int, j: int) -> str:
    return f"g{min(i, j)}_{max(i, j)}"


def ridge_sql(
    source: str, out: str, features: Sequence[int], y: int, alpha: float = 1.0, base: int | None = None
) -> str:
    """CTEs from ``source`` (n, s*, g*_*) to ``out`` with columns ``<out>_b0`` and ``<out>_b1`` ….

    ``features``, ``y`` and ``base`` are positions; with ``base`` the target is y minus it.
    """
    p = range(len(features))
    xy = [_g(f, y) + (f" - {_g(f, base)}" if base is not None else "") for f in features]
    steps = [[f"s{y}" + (f" - s{base}" if base is not None else "") + f" AS {out}_my"]]
    steps[0] += [f"s{features[i]} AS {out}_m{i}" for i in p]
    steps.append(
        [
            f"CASE WHEN {_g(features[i], features[i])} <= (2e-15 * {out}_m{i}) ** 2 THEN 1.0 "
            f"ELSE sqrt({_g(features[i], features[i])}) END AS {out}_d{i}"
            for i in p
        ]
    )
    scaled = []
    for i in p:
        scaled.append(f"n * ({xy[i]}) / {out}_d{i} AS {out}_r{i}")
        for j in range(i + 1):
            pen = f" + {alpha}" if i == j else ""
            scaled.append(f"n * {_g(features[i], features[j])} / {out}_d{i} / {out}_d{j}{pen} AS {out}_a{i}_{j}")
    steps.append(scaled)
    for j in p:
        left = "".join(f" - {out}_l{j}_{k} * {out}_l{j}_{k}" for k in range(j))
        steps.append([f"sqrt({out}_a{j}_{j}{left}) AS {out}_l{j}_{j}"])
        below = []
        for i in range(j + 1, len(features)):
            cross = "".join(f" - {out}_l{i}_{k} * {out}_l{j}_{k}" for k in range(j))
            below.append(f"({out}_a{i}_{j}{cross}) / {out}_l{j}_{j} AS {out}_l{i}_{j}")
        if below:
            steps.append(below)
    for i in p:
        back = "".join(f" - {out}_l{i}_{k} * {out}_z{k}" for k in range(i))
        steps.append([f"({out}_r{i}{back}) / {out}_l{i}_{i} AS {out}_z{i}"])
    for i in reversed(p):
        later = "".join(f" - {out}_l{k}_{i} * {out}_w{k}" for k in range(i + 1, len(features)))
        steps.append([f"({out}_z{i}{later}) / {out}_l{i}_{i} AS {out}_w{i}"])
    steps.append([f"{out}_w{i} / {out}_d{i} AS {out}_b{i + 1}" for i in p])
    intercept = "".join(f" - {out}_b{i + 1} * {out}_m{i}" for i in p)
    steps.append([f"{out}_my{intercept} AS {out}_b0"])
    ctes, previous = [], source
    for k, parts in enumerate(steps):
        name = out if k == len(steps) - 1 else f"{out}_step{k}"
        ctes.append(f"{name} AS (SELECT *, {', '.join(parts)} FROM {previous})")
        previous = name
    return ",\n".join(ctes)


def predict_sql(out: str, columns: Sequence[str], base: str | None = None) -> str:
    """The fitted value, about the means that ``ridge_sql`` left in its columns."""
    value = f"{out}_my" + "".join(f" + {out}_b{i + 1} * ({c} - {out}_m{i})" for i, c in enumerate(columns))
    return f"{value} + {base}" if base else value


def stump_sql(source: str, out: str, features: Sequence[str], key: str, y: str, leaf_rows: int) -> str:
    """CTEs from ``source`` to ``out``: per ``key`` the split with the most gain, as ``feature``, ``cut``, ``lo``, ``hi``, ``gain``."""
    long = " UNION ALL ".join(f"SELECT {key}, {i} AS feature, {c} AS x, {y} AS y FROM {source}" for i, c in enumerate(features))
    return f"""{out}_long AS ({long}),
{out}_mean AS (SELECT {key}, feature, avg(y) AS m, count(*) AS n FROM {out}_long GROUP BY ALL),
{out}_runs AS (SELECT {key}, feature, x, sum(y - m) AS r, count(*) AS k FROM {out}_long JOIN {out}_mean USING ({key}, feature) GROUP BY ALL),
{out}_cuts AS (
  SELECT *, sum(r) OVER w AS sl, sum(k) OVER w AS nl, lead(x) OVER (PARTITION BY {key}, feature ORDER BY x) AS above,
    sum(r) OVER (PARTITION BY {key}, feature) AS s FROM {out}_runs WINDOW w AS (PARTITION BY {key}, feature ORDER BY x)),
{out} AS (
  SELECT {key}, feature, x + (above - x) / 2 AS cut, m + sl / nl AS lo, m + (s - sl) / (n - nl) AS hi
  FROM {out}_cuts JOIN {out}_mean USING ({key}, feature) WHERE above IS NOT NULL AND nl >= {leaf_rows} AND n - nl >= {leaf_rows}
  QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY sl * sl / nl + (s - sl) * (s - sl) / (n - nl) DESC, feature, x) = 1)"""


def stump_value(out: str, features: Sequence[str], row: str = "t") -> str:
    """The value of the split of ``out`` for the features of ``row``."""
    x = "CASE {o}.feature {cases} END".format(o=out, cases=" ".join(f"WHEN {i} THEN {row}.{c}" for i, c in enumerate(features)))
    return f"CASE WHEN {x} <= {out}.cut THEN {out}.lo ELSE {out}.hi END"
