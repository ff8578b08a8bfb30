"""Harmonic tides: least-squares fit per station and reconstruction."""

from __future__ import annotations

import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hydrolake import config
from hydrolake.functions import risk


def omegas(names=("M2", "K1")) -> dict[str, float]:
    """Angular speeds in radians per hour."""
    return {n: 2 * math.pi / config.CONSTITUENT_PERIOD_H[n] for n in names}


def hours_since_epoch(time):
    c = F.col(time) if isinstance(time, str) else time
    return F.unix_micros(c.cast("timestamp")) / F.lit(3.6e9)


def normal_equations(obs: DataFrame, speeds: Mapping[str, float], by: str = "station", time: str = "t", value: str = "est") -> DataFrame:
    """Per station the sums of products that least squares needs; rows combine on the map side.

    Basis: 1, then cos(w t) and sin(w t) per constituent. Readings without a value are left out.
    """
    t = hours_since_epoch(time)
    basis = {"b0": F.lit(1.0)}
    for i, w in enumerate(speeds.values()):
        basis[f"b{2 * i + 1}"] = F.cos(F.lit(w) * t)
        basis[f"b{2 * i + 2}"] = F.sin(F.lit(w) * t)
    rows = obs.where(F.col(value).isNotNull() & ~F.isnan(value)).select(by, F.col(value).alias("_y"), *[c.alias(n) for n, c in basis.items()])
    names = list(basis)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(names) for b in names[i:]]
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), *sums, *[F.sum(F.col(a) * F.col("_y")).alias(f"{a}_y") for a in names])


def tide_fit(obs: DataFrame, speeds: Mapping[str, float] | None = None, by: str = "station", time: str = "t", value: str = "est") -> DataFrame:
    """(station, name, omega, amplitude, phase, mean): height = mean + sum(A cos(w t - g)).

    The heavy part is one grouped sum; what is solved in Python is one small system per station.
    Time counts from 1970-01-01.
    """
    speeds = dict(speeds or omegas())
    size = 2 * len(speeds) + 1
    names = [f"b{i}" for i in range(size)]

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                a = np.empty((size, size))
                for i in range(size):
                    for j in range(i, size):
                        a[i, j] = a[j, i] = row[f"{names[i]}_{names[j]}"]
                x = np.linalg.lstsq(a, np.array([row[f"{n}_y"] for n in names]), rcond=None)[0]
                for k, (name, w) in enumerate(speeds.items()):
                    c, s = x[2 * k + 1], x[2 * k + 2]
                    out.append((row[by], name, w, float(np.hypot(c, s)), float(np.arctan2(s, c)), float(x[0])))
            yield pd.DataFrame(out, columns=[by, "name", "omega", "amplitude", "phase", "mean"])

    sums = normal_equations(obs, speeds, by, time, value)
    key = sums.schema[by].dataType.simpleString()
    return sums.mapInPandas(solve, f"{by} {key}, name string, omega double, amplitude double, phase double, mean double")


def tide_predict(times: DataFrame, constituents: DataFrame, by: str = "station", time: str = "time", name: str = "est") -> DataFrame:
    """Height at each (station, time); 0 for stations without a model.

    Constituents (omega, amplitude, phase, mean, optional nodal f and u) are packed into one array
    per station, so rows are not multiplied by the number of constituents.
    """
    f = F.col("f") if "f" in constituents.columns else F.lit(1.0)
    u = F.col("u") if "u" in constituents.columns else F.lit(0.0)
    packed = constituents.groupBy(by).agg(
        F.first("mean").alias("_mean"),
        F.array_sort(F.collect_list(F.struct("omega", (f * F.col("amplitude")).alias("a"), (F.col("phase") - u).alias("g")))).alias("_c"),
    )
    t = hours_since_epoch(time)
    height = F.aggregate("_c", F.col("_mean"), lambda acc, c: acc + c["a"] * F.cos(c["omega"] * t - c["g"]))
    return times.join(packed, by, "left").withColumn(name, F.coalesce(height, F.lit(0.0))).drop("_mean", "_c")


def tide_warning(obs: DataFrame, value: str = "est", msl: str = "msl") -> DataFrame:
    return obs.withColumns({"warning": risk.tide_warning(value), "msl_alert": F.when(F.col(msl) > 1.0, 1).otherwise(0)})
