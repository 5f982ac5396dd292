"""Publishing cadence of outlets: (outlet, published_at, updated_at)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.ml.feature import PolynomialExpansion
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsfold.functions.runtime import lagged

DAY, DEFAULT_MINUTES = 1440.0, 30.0
#: Places of a log that are looked through together.
RUN = 10_000


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def inter_arrival(log: DataFrame) -> DataFrame:
    """(outlet, published_at, time_diff, minutes_since_midnight): minutes since the outlet's previous article; updated ones are left out, the first of an outlet goes."""
    new = log.where("updated_at is null")
    rows = lagged(new, "outlet", "published_at", F.date_trunc("hour", "published_at"), "__b", "published_at").where("__b is not null")
    diff = F.timestamp_diff("MICROSECOND", F.col("__b"), F.col("published_at")) / 60e6
    return rows.select("outlet", "published_at", diff.alias("time_diff"), minute_of_day(F.col("published_at")).alias("minutes_since_midnight"))


def check_publish_log(log: DataFrame, order: str = "pos", bucket: Column | None = None) -> DataFrame:
    """Rows of a newest-first log (outlet, pos, published_at, updated_at) that are later than the row before; updated rows are skipped.

    bucket: what rises with the order and says which rows a task takes together; if order is a number, ``RUN`` places.
    """
    new = log.where("updated_at is null")
    rows = lagged(new, "outlet", order, F.floor(F.col(order) / RUN) if bucket is None else bucket, "previous", "published_at")
    return rows.where(F.col("published_at") > F.col("previous"))


def fit_cadence(arrivals: DataFrame, degree: int = 5) -> tuple[float, list[float]]:
    """(intercept, coefficients of m, m^2, ...) of minutes to the next article over the minute of the day m.

    Minutes are scaled to a day before powers are taken and the coefficients scaled back.
    """
    rows = arrivals.select(F.col("time_diff").cast("double").alias("label"), array_to_vector(F.array(F.col("minutes_since_midnight") / DAY)).alias("x"))
    poly = PolynomialExpansion(degree=degree, inputCol="x", outputCol="features").transform(rows)
    model = LinearRegression(solver="normal").fit(poly)
    return float(model.intercept), [float(c) / DAY ** (i + 1) for i, c in enumerate(model.coefficients)]


def _scaled(minutes: Column) -> Column:
    """The minute of the day as -1 to 1, so that its powers stay of one size."""
    return minutes.cast("double") / F.lit(DAY / 2) - 1


def cadence_moments(arrivals: DataFrame, degree: int = 5) -> DataFrame:
    """(outlet, n, powers, products): sums of x^0 .. x^2d and of y, x y, .. x^d y over an outlet's arrivals, x the scaled minute and y the wait.

    They are combined before the shuffle, so an outlet costs a row a task however many arrivals it has.
    """
    x, y = F.col("x"), F.col("time_diff").cast("double")

    def power(k: int) -> Column:
        return F.lit(1.0) if not k else x if k == 1 else F.pow(x, F.lit(k))

    rows = arrivals.where("time_diff is not null and minutes_since_midnight is not null").withColumn("x", _scaled(F.col("minutes_since_midnight")))
    sums = rows.groupBy("outlet").agg(F.count(F.lit(1)).alias("n"), *[F.sum(power(k)).alias(f"p{k}") for k in range(2 * degree + 1)], *[F.sum(power(k) * y).alias(f"q{k}") for k in range(degree + 1)])
    return sums.select("outlet", "n", F.array(*[f"p{k}" for k in range(2 * degree + 1)]).alias("powers"), F.array(*[f"q{k}" for k in range(degree + 1)]).alias("products"))


def fit_cadences(arrivals: DataFrame, degree: int = 5) -> DataFrame:
    """(outlet, n, intercept, coefficients): for each outlet the least-squares polynomial of the wait over the minute of the day (m, m^2, ...).

    One aggregation gives the moments; each outlet's normal equations are solved on its own row, wherever that is. An outlet with fewer
    different minutes than the polynomial has terms gets the solution of least norm.
    """

    def solve(batches):
        for pdf in batches:
            out = []
            for powers, products in zip(pdf["powers"], pdf["products"], strict=True):
                d = len(products)
                c = np.linalg.lstsq(np.array([[powers[i + j] for j in range(d)] for i in range(d)]), np.asarray(products), rcond=1e-12)[0]
                poly = np.polynomial.Polynomial(c)(np.polynomial.Polynomial([-1, 2 / DAY]))
                out.append([float(x) for x in np.pad(poly.coef, (0, d - len(poly.coef)))])
            yield pd.DataFrame({"outlet": pdf["outlet"], "n": pdf["n"], "intercept": [c[0] for c in out], "coefficients": [c[1:] for c in out]})

    return cadence_moments(arrivals, degree).mapInPandas(solve, f"outlet {arrivals.schema['outlet'].dataType.simpleString()}, n long, intercept double, coefficients array<double>")


def estimated_delay(ts: Column, model: tuple[float, Sequence[float]] | None) -> Column:
    """Minutes to the next article after ts; half an hour without a model."""
    if model is None:
        return F.lit(DEFAULT_MINUTES)
    m, out = minute_of_day(ts).cast("double"), F.lit(0.0)
    for c in reversed(model[1]):
        out = (out + F.lit(float(c))) * m
    return out + F.lit(float(model[0]))


def with_delay(rows: DataFrame, models: DataFrame, time: str = "last_at") -> DataFrame:
    """rows (outlet and a time) with ``delay`` by the model of their outlet (of ``fit_cadences``); half an hour without one."""
    m = minute_of_day(F.col(time)).cast("double")
    delay = F.aggregate(F.reverse("coefficients"), F.lit(0.0), lambda out, c: (out + c) * m) + F.col("intercept")
    known = models.select(F.col("outlet").alias("__outlet"), "intercept", "coefficients")  # a row for each outlet
    return rows.join(known, F.col("outlet") == F.col("__outlet"), "left").select(*rows.columns, F.coalesce(delay, F.lit(DEFAULT_MINUTES)).alias("delay"))


def next_scan_at(outlets: DataFrame, model: tuple[float, Sequence[float]] | DataFrame | None) -> DataFrame:
    """outlets (outlet, last_at) with delay and ``next_at``; model: one for all, or the models of ``fit_cadences``."""
    rows = with_delay(outlets, model) if isinstance(model, DataFrame) else outlets.withColumn("delay", estimated_delay(F.col("last_at"), model))
    return rows.withColumn("next_at", F.timestamp_add("SECOND", F.round(F.col("delay") * 60).cast("int"), F.col("last_at")))


def regression_error(rows: DataFrame, label: str = "label", predicted: str = "predicted", *by: str) -> DataFrame:
    """(by..., n, mae, mse)."""
    e = F.col(predicted) - F.col(label)
    return rows.groupBy(*by).agg(F.count(e).alias("n"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def inspection_sample(rows: DataFrame, n: int = 200, seed: int = 7) -> DataFrame:
    """n rows chosen by a seeded hash, so that a repeated run shows the same."""
    return rows.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in rows.columns])).limit(n)
