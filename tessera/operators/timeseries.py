"""Time series by key: smoothing, differences, trend, season, autocorrelation and autoregressive forecasts.

Windows by key do what they can; a series that is needed as a whole is gathered into one array or frame.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def moving_average(df: DataFrame, by: list[str], order: list[str], value: str, size: int, name: str = "mean") -> DataFrame:
    return df.withColumn(name, F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - size, 0)))


def differences(df: DataFrame, by: list[str], order: list[str], value: str, lag: int = 1, name: str = "change") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value, lag).over(Window.partitionBy(*by).orderBy(*order)))


def trend(df: DataFrame, by: list[str], time: str, value: str) -> DataFrame:
    """Least-squares line by key: slope, intercept, r2."""
    return df.groupBy(*by).agg(F.regr_slope(value, time).alias("slope"), F.regr_intercept(value, time).alias("intercept"), F.regr_r2(value, time).alias("r2"))


def season(df: DataFrame, by: list[str], phase: str, value: str) -> DataFrame:
    """Mean deviation from the key's mean in each phase."""
    w = Window.partitionBy(*by)
    return df.withColumn("_d", F.col(value) - F.avg(value).over(w)).groupBy(*by, phase).agg(F.avg("_d").alias("effect"))


def exponential_smoothing(df: DataFrame, by: list[str], order: list[str], value: str, alpha: float, name: str = "smooth") -> DataFrame:
    """s = alpha * x + (1 - alpha) * s before, from the first value on; null values leave it as it is. One row for each row of df that has a value."""
    at = F.struct(*order, F.col(value).cast("double").alias("_x"))
    series = df.filter(F.col(value).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(at)).alias("_s"))
    start = F.array().cast("array<double>")
    step = lambda acc, s: F.concat(acc,
        F.array(F.when(F.size(acc) > 0, alpha * s["_x"] + (1 - alpha) * F.get(acc, F.size(acc) - 1)).otherwise(s["_x"])))
    both = series.withColumn("_e", F.aggregate("_s", start, step)).select(*by, F.explode(F.arrays_zip("_s", "_e")).alias("_z"))
    return both.select(*by, *(F.col(f"_z._s.{o}").alias(o) for o in order), F.col("_z._e").alias(name))


def autocorrelation(df: DataFrame, by: list[str], order: list[str], value: str, lags: list[int]) -> DataFrame:
    """by, lag, r: correlation of a series with itself shifted."""
    w = Window.partitionBy(*by).orderBy(*order)
    out = None
    for lag in lags:
        part = df.withColumn("_l", F.lag(value, lag).over(w)).groupBy(*by).agg(F.lit(lag).alias("lag"), F.corr(value, "_l").alias("r"))
        out = part if out is None else out.union(part)
    return out


def forecast_ar(df: DataFrame, by: list[str], order: list[str], value: str, p: int, steps: int) -> DataFrame:
    """by, step (from 1), value: forecasts of an autoregressive model with intercept, fitted by least squares to each series."""
    kinds = dict(df.dtypes)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        x = frame.sort_values(order)[value].dropna().to_numpy(float)
        if len(x) < 2 * p + 1:
            return pd.DataFrame(columns=[*by, "step", "value"])
        rows = np.column_stack([np.ones(len(x) - p)] + [x[p - i - 1 : len(x) - i - 1] for i in range(p)])
        w = np.linalg.lstsq(rows, x[p:], rcond=None)[0]
        past, out = list(x), []
        for _ in range(steps):
            past.append(float(w[0] + w[1:] @ np.array(past[: -p - 1 : -1])))
            out.append(past[-1])
        return pd.DataFrame({**{b: [frame[b].iloc[0]] * steps for b in by}, "step": range(1, steps + 1), "value": out})

    return df.groupBy(*by).applyInPandas(run, ", ".join([*(f"{b} {kinds[b]}" for b in by), "step int", "value double"]))
