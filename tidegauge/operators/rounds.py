"""Huber regression of long targets by rounds of distributed sums.

No target's rows are gathered: a round reads the rows once for the sums that the next step
needs (those of the normal equations of the rows inside the threshold, of the reweighted
ones, and the gradient) and once more for the objective at a handful of candidates. The
state between rounds is a few numbers a target, on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.operators import moments
from tidegauge.operators.models import COEF, HUBER_ALPHA, HUBER_EPSILON, INTERCEPT, SHARES
from tidegauge.session import settle

MOST_TARGETS = 10_000  # whose states the driver and each task hold
TOLERANCE = 1e-10  # of the relative gradient


def _sums(rows: DataFrame, by: list[str], states: dict[tuple, np.ndarray], of) -> dict[tuple, np.ndarray]:
    """``of(design, goal, state)`` summed over each key's rows, keys that have a state only."""
    stats = T.StructField("_s", T.ArrayType(T.DoubleType()))
    schema = T.StructType([rows.schema[c] for c in by] + [stats])

    def reduce(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for key, part in frame.groupby(by, dropna=False, sort=False)["_v"]:
                key = tuple(None if pd.isna(x) else x for x in key)
                if key in states:
                    table = np.stack(part.to_numpy())
                    design = np.column_stack([table[:, :-1], np.ones(len(table))])
                    held[key] = held.get(key, 0.0) + of(design, table[:, -1], states[key])
        if held:
            out = pd.DataFrame(list(held), columns=by, dtype=object)
            out["_s"] = list(held.values())
            yield out

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame[by].head(1).copy()
        out["_s"] = [np.sum(np.stack(frame["_s"].to_numpy()), axis=0)]
        return out

    # one row a task and key
    total = rows.mapInPandas(reduce, schema).groupBy(*by).applyInPandas(add, schema)
    found = total.toPandas()  # at most MOST_TARGETS rows
    keys = found[by].itertuples(index=False, name=None)
    return {tuple(None if pd.isna(x) else x for x in k): np.asarray(v) for k, v in zip(keys, found["_s"])}


def _split(state: np.ndarray, k: int):
    return state[:k], state[k]


def _statistics(epsilon: float, k: int):
    """Sums at a state: counts, gradient and the two systems; ``k`` counts the constant."""

    def of(d: np.ndarray, goal: np.ndarray, state: np.ndarray) -> np.ndarray:
        coef, scale = _split(state, k)
        resid = goal - d @ coef
        inside = np.abs(resid) <= epsilon * scale
        near = np.where(inside, resid, 0.0)
        pull = np.where(inside, resid / scale, epsilon * np.sign(resid))
        weight = 1.0 / np.maximum(1.0, np.abs(resid) / (epsilon * scale)) / scale
        own, heavy = d * inside[:, None], d * weight[:, None]
        return np.concatenate(
            [
                [len(d), (~inside).sum(), (near**2).sum()],
                d.T @ pull,
                np.abs(d).T @ np.abs(pull),
                d.T @ near,
                heavy.T @ goal,
                (own.T @ own).ravel(),
                (heavy.T @ d).ravel(),
            ]
        )

    return of


def _objectives(epsilon: float, k: int):
    """Sums of the loss at several states laid end to end."""

    def of(d: np.ndarray, goal: np.ndarray, states: np.ndarray) -> np.ndarray:
        out = []
        for state in states.reshape(-1, k + 1):
            coef, scale = _split(state, k)
            size = np.abs(goal - d @ coef)
            loss = np.where(size <= epsilon * scale, size**2 / scale, 2 * epsilon * size - epsilon**2 * scale)
            out.append(loss.sum() + len(d) * scale)
        return np.array(out)

    return of


def _candidates(sums: np.ndarray, state: np.ndarray, penalty: np.ndarray, epsilon: float, k: int):
    """The relative gradient at a state, and the states that may follow it, itself first."""
    coef, scale = _split(state, k)
    n, n_out, squares = sums[:3]
    pull, size, near, cross = sums[3 : 3 + 4 * k].reshape(4, k)
    inner, heavy = sums[3 + 4 * k :].reshape(2, k, k)
    slope = np.append(-2 * pull + 2 * penalty * coef, n - squares / scale**2 - epsilon**2 * n_out)
    terms = np.append(2 * size + 2 * np.abs(penalty * coef), n + squares / scale**2 + epsilon**2 * n_out)
    gradient = np.max(np.abs(slope) / np.maximum(terms, 1e-300))
    hess = np.empty((k + 1, k + 1))
    hess[:k, :k] = 2 / scale * inner + 2 * np.diag(penalty)
    hess[:k, k] = hess[k, :k] = 2 / scale**2 * near
    hess[k, k] = 2 * squares / scale**3
    hess += 1e-12 * np.trace(hess) * np.eye(k + 1)
    step = np.linalg.solve(hess, -slope)
    room = n - n_out * epsilon**2
    wide = np.sqrt(squares / room) if room > 0 and squares > 0 else scale
    least = np.linalg.solve(heavy + np.diag(penalty), cross)
    made = [state, np.append(least, scale), np.append(least, wide), np.append(coef, wide)]
    for share in SHARES:
        made.append(np.append(coef + share * step[:k], max(scale + share * step[k], scale / 10)))
    return gradient, np.stack(made)


def fit_huber_by_rounds(
    rows: DataFrame,
    by: Sequence[str],
    features: Sequence[str],
    target: str = "y",
    epsilon: float = HUBER_EPSILON,
    alpha: float = HUBER_ALPHA,
    max_rounds: int = 60,
) -> DataFrame:
    """``models.fit_huber`` for a few targets of any length, with the ``gradient`` reached.

    Same objective and columns. Features and target are standardised by their merged moments
    first, so large means lose no digits. A round takes the candidate of lowest objective: a
    share of the Newton step, or a reweighted least-squares step, which always descends.
    More than ``MOST_TARGETS`` targets raise: those fit in arrays. A target that is fitted
    exactly or has not come to rest after ``max_rounds`` has ``converged`` false.
    """
    by, columns = list(by), [*features, target]
    k, spark = len(columns), rows.sparkSession
    used = settle(
        rows.dropna(subset=columns).select(*by, F.array(*[F.col(c).cast("double") for c in columns]).alias("_v")),
        "rounds",
    )
    split = used.select(*by, *[F.col("_v")[i].alias(f"_c{i}") for i in range(k)])
    found = moments.moments(split, by, [f"_c{i}" for i in range(k)]).limit(MOST_TARGETS + 1).toPandas()
    if len(found) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets: use fit_huber")
    width = moments.width_of(k)
    keys = [tuple(None if pd.isna(x) else x for x in key) for key in found[by].itertuples(index=False, name=None)]
    blocks = {key: moments.merged(np.reshape(b, (-1, width)), k) for key, b in zip(keys, found[moments.BLOCKS])}
    shift, spread, penalty, states = {}, {}, {}, {}
    for key, block in blocks.items():
        products = moments.full_matrix(block[None], k)[0]
        sd = np.sqrt(np.diag(products) / block[0])
        sd[sd <= 1e-14 * np.abs(block[2 : 2 + k])] = 1.0
        shift[key], spread[key] = block[2 : 2 + k], sd
        # on the standardised scale, divided by the target's deviation
        penalty[key] = np.append(alpha * sd[-1] / sd[:-1] ** 2, 0.0)
        scaled = products / np.outer(sd, sd)
        coef = np.linalg.solve(scaled[:-1, :-1] + np.diag(penalty[key][:-1]) + 1e-12 * np.eye(k - 1), scaled[:-1, -1])
        left = max(scaled[-1, -1] - 2 * coef @ scaled[:-1, -1] + coef @ scaled[:-1, :-1] @ coef, 1e-18)
        states[key] = np.concatenate([coef, [0.0, np.sqrt(left / block[0])]])

    def standard(of):
        def on(design: np.ndarray, goal: np.ndarray, state: np.ndarray) -> np.ndarray:
            move, scale, inner = state[:k], state[k : 2 * k], state[2 * k :]
            design = design.copy()
            design[:, :-1] = (design[:, :-1] - move[:-1]) / scale[:-1]
            return of(design, (goal - move[-1]) / scale[-1], inner)

        return on

    live, gradient, steps = set(states), dict.fromkeys(states, np.inf), dict.fromkeys(states, 0)
    for _ in range(max_rounds):
        with_scale = {key: np.concatenate([shift[key], spread[key], states[key]]) for key in live}
        sums = _sums(used, by, with_scale, standard(_statistics(epsilon, k)))
        made = {}
        for key in live:
            gradient[key], made[key] = _candidates(sums[key], states[key], penalty[key], epsilon, k)
        live = {key for key in live if gradient[key] > TOLERANCE and states[key][k] > 1e-9}
        if not live:
            break
        asked = {key: np.concatenate([shift[key], spread[key], made[key].ravel()]) for key in live}
        values = _sums(used, by, asked, standard(_objectives(epsilon, k)))
        for key in list(live):
            total = values[key] + (penalty[key] * made[key][:, :k] ** 2).sum(axis=1)
            total[~np.isfinite(total)] = np.inf
            # near the end objectives differ by rounding only: there the full Newton step is right
            full = len(made[key]) - len(SHARES)
            best = full if total[full] <= total.min() * (1 + 1e-13) else int(total.argmin())
            steps[key] += 1
            if best == 0:  # nothing is lower
                live.discard(key)
            states[key] = made[key][best]
    out = []
    for key, state in states.items():
        coef = state[: k - 1] * spread[key][-1] / spread[key][:-1]
        intercept = state[k - 1] * spread[key][-1] + shift[key][-1] - coef @ shift[key][:-1]
        done = bool(gradient[key] <= 1e-8 and state[k] > 1e-9)
        out.append(
            (*key, float(intercept), coef.tolist(), int(blocks[key][0]), float(state[k] * spread[key][-1]), done, steps[key], float(gradient[key]))
        )
    kinds = {
        INTERCEPT: T.DoubleType(), COEF: T.ArrayType(T.DoubleType()), "n_rows": T.LongType(), "scale": T.DoubleType(),
        "converged": T.BooleanType(), "steps": T.IntegerType(), "gradient": T.DoubleType(),
    }
    schema = T.StructType([rows.schema[c] for c in by] + [T.StructField(n, t) for n, t in kinds.items()])
    plain = [tuple(x.item() if isinstance(x, np.generic) else x for x in row) for row in out]
    return spark.createDataFrame(plain, schema)
