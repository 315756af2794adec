"""Bootstrap intervals whose paths are dealt over tasks, with exact quantiles by counting.

``forecast.forecast_interval`` holds one target's paths in one row. Here a target's draws are
cut into ranges, so that one target with any number of paths uses the whole cluster. No path
is stored or shuffled: draws are integer arithmetic, so each round makes them again and
counts them by the leading bits of their value. A round narrows every wanted order statistic
to one of at most 1,024 parts, of fewer where few values are left, and a range sends the
counts of a part's own parts as one array; once few enough values are left they are gathered
and sorted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions.power import yeo_johnson_inverse
from tidegauge.operators.forecast import INTERVAL, MODULUS, N_BOOT, SEED, draw_range, forecast_rows
from tidegauge.operators.spread import spread
from tidegauge.schema import no_nan
from tidegauge.session import settle

PATHS = 25_000  # of one range: a task holds this many times the horizon
KEEP = 1_000  # values of one part that are gathered
FIRST, BITS, LEAST_BITS = 52, 10, 6  # bits left open by the first round, most and least bits a round adds
FEW = 64  # values of one part that a round aims at
ROWS = 50  # ranges whose counts are handed on together


def ordered_bits(values: np.ndarray) -> np.ndarray:
    """Integers in the order of the doubles; both zeros are one value."""
    bits = (values + 0.0).view(np.int64)
    return np.where(bits < 0, np.int64(-0x8000000000000000) - bits, bits)


def from_bits(bits: np.ndarray) -> np.ndarray:
    return np.where(bits < 0, np.int64(-0x8000000000000000) - bits, bits).view(np.float64)


def has_inverse(z: np.ndarray, lam: float, mu: float, sd: float) -> np.ndarray:
    """Whether the power transform's inverse is defined for standardised values."""
    v = z * sd + mu
    return np.isfinite(v) & np.where(v >= 0, lam * v + 1 > 0, 1 - (2 - lam) * v > 0)


def _paths(row: dict, n_boot: int, size: int, seed: int, picks: dict[tuple, np.ndarray]) -> np.ndarray:
    """The paths of one range of draws, a row per step.

    ``picks`` remembers a few ranges' choices of residuals; many targets share them.
    """
    drive, resid = np.asarray(row["drive"], dtype=float), np.asarray(row["resid"], dtype=float)
    asked = (row["part"], len(drive), len(resid))
    if asked not in picks:
        if len(picks) == 8:
            picks.clear()
        first = row["part"] * size
        drawn = draw_range(first, min(first + size, n_boot), len(drive), seed) % len(resid)
        picks[asked] = np.ascontiguousarray(drawn.T)
    out = resid[picks[asked]]
    y = np.full(out.shape[1], row["start"], dtype=float)
    for t, d in enumerate(drive):
        y = d + row["phi"] * y + out[t]
        out[t] = y
    return out


def _bits(paths: np.ndarray, row: dict) -> list[np.ndarray]:
    """Per step the ordered bits of the values that can be brought back."""
    scale = (row["lam"], row["mu"], row["sd"])
    # those form an interval, so its ends tell of all between; NaN fails
    if has_inverse(np.array([paths.min(), paths.max()]), *scale).all():
        return list(ordered_bits(paths))
    inside = has_inverse(paths, *scale)
    return [ordered_bits(p[i]) for p, i in zip(paths, inside)]


def _over_ranges(parts: DataFrame, by: list[str], columns: str, of: Callable, n_boot: int, size: int, seed: int):
    """Keys and the rows that ``of(row, step, bits)`` makes of each step of each range of draws."""

    tail = T.StructType.fromDDL(columns)
    names = tail.fieldNames()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        picks: dict[tuple, np.ndarray] = {}
        for frame in frames:
            for first in range(0, len(frame), ROWS):
                keys, out = [], []
                for row in frame.iloc[first : first + ROWS].to_dict("records"):
                    key = tuple(row[c] for c in by)
                    for t, bits in enumerate(_bits(_paths(row, n_boot, size, seed, picks), row)):
                        made = of(row, t, bits) if len(bits) else []
                        keys += [key] * len(made)
                        out += [(t + 1, *m) for m in made]
                if out:
                    held = {c: pd.Series(list(k), dtype=object) for c, k in zip(by, zip(*keys))}
                    yield pd.DataFrame(held | {c: list(v) for c, v in zip(names, zip(*out))})

    return parts.mapInPandas(run, T.StructType([parts.schema[c] for c in by] + tail.fields))


def _first_counts(row: dict, t: int, bits: np.ndarray) -> list[tuple]:
    """Each part of the first round that has values, and how many."""
    lowest = -(1 << (63 - FIRST))
    n = np.bincount((bits >> FIRST) - lowest)
    return [(int(i) + lowest, int(n[i])) for i in np.flatnonzero(n)]


def _part_counts(shift: int, before: int) -> Callable:
    """For each wanted part the counts of its own parts, whether or not they have values."""
    wide = 1 << (before - shift)

    def of(row: dict, t: int, bits: np.ndarray) -> list[tuple]:
        upper, own = bits >> before, (bits >> shift) & (wide - 1)
        held = ((int(p), upper == p) for p in row["wanted"][t])
        return [(p, np.bincount(own[at], minlength=wide)) for p, at in held if at.any()]

    return of


def _part_values(shift: int) -> Callable:
    """The values of each wanted part."""

    def of(row: dict, t: int, bits: np.ndarray) -> list[tuple]:
        upper = bits >> shift
        held = ((int(p), bits[upper == p]) for p in row["wanted"][t])
        return [(p, values) for p, values in held if len(values)]

    return of


def _place(counts: pd.Series, rest: pd.Series) -> pd.DataFrame:
    """The part that holds a rank, the rank's place inside and how many values the part holds."""
    out = [np.empty((0, 3), np.int64)]
    for i in range(0, len(counts), 1000):
        n = np.stack(counts.iloc[i : i + 1000].to_numpy())
        upto, asked = n.cumsum(axis=1), rest.iloc[i : i + 1000].to_numpy(np.int64)
        own = (upto <= asked[:, None]).sum(axis=1)
        row = np.arange(len(n))
        out.append(np.column_stack([own, asked - upto[row, own] + n[row, own], n[row, own]]))
    return pd.DataFrame(np.concatenate(out), columns=["own", "rest", "n"])


def _narrow(counted: DataFrame, ranks: DataFrame, by: list[str], shift: int, before: int) -> DataFrame:
    """Each rank's part after a round, its place inside and how many values the part holds."""
    # an array a range
    gathered = counted.groupBy(*by, "step", "parent").agg(F.collect_list("counts").alias("_c"))
    rest = F.slice("_c", 2, F.size("_c"))
    total = F.aggregate(rest, F.col("_c")[0], lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    asked = ranks.select(*by, "step", "level", "side", "rest", "n_paths", F.col("part").alias("parent"))
    found = asked.join(gathered.withColumn("_c", total), [*by, "step", "parent"])
    place = F.pandas_udf(_place, "own long, rest long, n long")
    placed = found.withColumn("_p", place("_c", "rest"))
    part = F.shiftleft("parent", before - shift) + F.col("_p.own")
    return placed.select(*by, "step", "level", "side", "n_paths", part.alias("part"), "_p.rest", "_p.n")


def _first(counted: DataFrame, by: list[str], levels: Sequence[float]) -> DataFrame:
    """The two order statistics around each level, as parts of the first round."""
    window = Window.partitionBy(*by, "step").orderBy("part")
    running = counted.withColumn("upto", F.sum("n").over(window))
    total = counted.groupBy(*by, "step").agg(F.sum("n").alias("n_paths"))
    asked = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(q).alias("q")) for k, q in enumerate(levels)]))
    at = F.col("q") * (F.col("n_paths") - 1)
    sides = F.explode(F.array(F.lit(0), F.lit(1)))
    ranks = total.withColumn("_l", asked).select(*by, "step", "n_paths", "_l.*", sides.alias("side"))
    rest = F.least(F.floor(at) + F.col("side"), F.col("n_paths") - 1).cast("long")
    ranks = ranks.withColumn("rest", rest).drop("q")
    inside = (F.col("rest") >= F.col("upto") - F.col("n")) & (F.col("rest") < F.col("upto"))
    found = ranks.join(running, [*by, "step"]).filter(inside)
    return found.withColumn("rest", F.col("rest") - F.col("upto") + F.col("n")).drop("upto")


def _with_wanted(parts: DataFrame, ranks: DataFrame, by: list[str]) -> DataFrame:
    """Each range of draws with its key's parts of interest, an array per step; keys without any go."""
    per_step = ranks.groupBy(*by, "step").agg(F.collect_set("part").alias("_p"))
    ordered = F.sort_array(F.collect_list(F.struct("step", "_p")))
    maps = per_step.groupBy(*by).agg(F.map_from_entries(ordered).alias("_m"))
    none = F.array().cast("array<bigint>")
    wanted = F.transform(F.sequence(F.lit(1), F.size("drive")), lambda t: F.coalesce(F.col("_m")[t], none))
    return parts.join(maps, by).withColumn("wanted", wanted).drop("_m")


def order_statistics(
    inputs: DataFrame,
    by: Sequence[str],
    n_boot: int = N_BOOT,
    seed: int = SEED,
    levels: Sequence[float] = INTERVAL,
    paths: int = PATHS,
    keep: int = KEEP,
) -> DataFrame:
    """Key, ``step``, ``level`` (place in ``levels``), ``side`` (0 below, 1 above), ``bits`` and ``n_paths``.

    ``n_paths`` counts the paths that have a value on the original scale; the others are left
    out. ``paths`` and ``keep`` bound the memory of a task and do not change the result.
    """
    by = list(by)
    if n_boot * 64 > MODULUS:
        raise ValueError(f"draws repeat beyond {MODULUS // 64} paths")
    ranges = F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // paths)))
    columns = [*by, "start", "phi", "drive", "resid", "lam", "mu", "sd"]
    rows = inputs.filter(F.size("resid") > 0).select(*columns, ranges.alias("part"))
    parts = settle(rows, "draws")

    def made(source, columns, of):
        return _over_ranges(spread(source, [*by, "part"]), by, f"step int, {columns}", of, n_boot, paths, seed)

    counts = made(parts, "part long, n long", _first_counts).groupBy(*by, "step", "part").agg(F.sum("n").alias("n"))
    shift, ranks = FIRST, settle(_first(settle(counts, "counts"), by, levels), "ranks")
    # one number a round reaches the driver
    while shift > 0 and (most := ranks.agg(F.max("n")).head()[0] or 0) > keep:
        bits = min(BITS, max(LEAST_BITS, (most // FEW).bit_length()))
        before, shift = shift, max(shift - bits, 0)
        counts = made(_with_wanted(parts, ranks, by), "parent long, counts array<long>", _part_counts(shift, before))
        ranks = settle(_narrow(counts, ranks, by, shift, before), "ranks")
    if shift == 0:  # every bit is known
        return ranks.select(*by, "step", "level", "side", F.col("part").alias("bits"), "n_paths")
    left = made(_with_wanted(parts, ranks, by), "part long, bits array<long>", _part_values(shift))
    held = left.groupBy(*by, "step", "part").agg(
        F.sort_array(F.flatten(F.collect_list("bits"))).alias("_b")  # at most ``keep`` values
    )
    found = ranks.join(held, [*by, "step", "part"])
    at = F.get("_b", F.col("rest").cast("int"))
    return found.select(*by, "step", "level", "side", at.alias("bits"), "n_paths")


def forecast_interval_dealt(
    inputs: DataFrame,
    by: Sequence[str],
    n_boot: int = N_BOOT,
    seed: int = SEED,
    levels: tuple[float, float] = INTERVAL,
    paths: int = PATHS,
    keep: int = KEEP,
) -> DataFrame:
    """As ``forecast.forecast_interval``, with the paths of a target dealt over tasks.

    Besides its columns, ``n_paths``: the paths counted at the step. The bounds equal those of
    the paths in one row. A key without residuals, or a step without a path that can be
    brought back, has null bounds and no paths.
    """
    by = list(by)

    @F.pandas_udf("double")
    def value(bits: pd.Series) -> pd.Series:
        return pd.Series(from_bits(bits.to_numpy(dtype=np.int64)))

    inputs = settle(inputs, "inputs")  # three branches read what a fit and a scenario made
    stats = order_statistics(inputs, by, n_boot, seed, levels, paths, keep).withColumn("z", value("bits"))
    scale = inputs.select(*by, "lam", "mu", "sd")
    back = yeo_johnson_inverse(F.col("z") * F.col("sd") + F.col("mu"), F.col("lam"))
    stats = stats.join(scale, by).withColumn("v", back)

    def bound(k):
        a, b = (F.max(F.when((F.col("level") == k) & (F.col("side") == s), F.col("v"))) for s in (0, 1))
        at = F.lit(levels[k]) * (F.max("n_paths") - 1)
        return a + (b - a) * (at - F.floor(at))

    bounds = stats.groupBy(*by, "step").agg(
        bound(0).alias("ic_inferior"), bound(1).alias("ic_superior"), F.max("n_paths").alias("n_paths")
    )
    rows = forecast_rows(inputs, by).toDF(*by, "step", "data", "z", "valor").drop("z")
    made = rows.join(bounds, [*by, "step"], "left").fillna(0, ["n_paths"])
    bounded = made.withColumns({c: no_nan(F.col(c)) for c in ("ic_inferior", "ic_superior", "valor")})
    return bounded.select(*by, "step", "data", "ic_inferior", "ic_superior", "valor", "n_paths")
