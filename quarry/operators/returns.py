"""Forward returns after an event and their regression on a signal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

WINDOWS = (5, 20)


def group_of(form: Column) -> Column:
    up = F.upper(form)
    return F.when(up.isin("10-K", "10-Q"), "periodic").when(up == "TRANSCRIPT", "transcripts").otherwise("other")


def forward(events: DataFrame, prices: DataFrame, windows=WINDOWS, key: str = "ticker") -> DataFrame:
    """(events' columns, window, ret): from the first price strictly after the event to the one `window` rows later.

    Windows are over the calendar alone: the prices' dates and the distinct dates of events, so a key with
    many events is no larger a group than its days. Dates go from the last to the first, and each takes the price row seen
    just before it, which a running frame keeps without going over it again. Events then meet their date's returns in one join.
    """
    order = Window.partitionBy(key).orderBy("date")
    ahead = F.array(*[F.struct(F.lit(w).alias("window"), (F.lead("close", w).over(order) / F.col("close") - 1).alias("ret")) for w in windows])
    laid = prices.select(key, "date", ahead.alias("ahead"), F.lit(0).alias("event"))
    days = events.select(key, "date").distinct().select(key, "date", F.lit(None).cast(laid.schema["ahead"].dataType).alias("ahead"), F.lit(1).alias("event"))
    # from behind, an event's day comes before the price row of that day: the next price is strictly after it
    seen = Window.partitionBy(key).orderBy(F.desc("date"), F.desc("event")).rowsBetween(Window.unboundedPreceding, -1)
    found = laid.unionByName(days).withColumn("ahead", F.last("ahead", ignorenulls=True).over(seen)).where("event = 1")
    found = found.select(F.col(key).alias("_key"), F.col("date").alias("_date"), "ahead")
    met = events.join(found, (F.col(key) == F.col("_key")) & (F.col("date") == F.col("_date")))
    return met.select(*events.columns, F.inline("ahead")).where("ret is not null")


def enrich(events: DataFrame, prices: DataFrame, market: DataFrame, windows=WINDOWS, key: str = "ticker") -> DataFrame:
    """Events with their own forward returns and the market's for the same date and window; a missing market is null."""
    dates = events.select("date").distinct().withColumn(key, F.lit("_market"))
    of_market = forward(dates, market.withColumn(key, F.lit("_market")), windows, key).select("date", "window", F.col("ret").alias("mkt"))
    return forward(events, prices, windows, key).join(of_market, ["date", "window"], "left")


def ols(rows: DataFrame, by: list[str], y: str = "ret", x: str = "signal", control: str | None = None) -> DataFrame:
    """(by, n, coef, intercept, t_stat, r2, rmse, mae) of y on x and at most one control, from centred sums.

    Rows with a null or NaN in any of them don't count. Too few rows, or a singular matrix, give NaN with the true n.
    """
    names = [y, x, *([control] if control else [])]
    good = rows
    for c in names:
        good = good.where(F.col(c).isNotNull() & ~F.isnan(c))
    z = F.col(control) if control else F.lit(0.0)
    rows_z = good.withColumn("_z", z.cast("double"))
    means = rows_z.groupBy(*by).agg(F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.avg("_z").alias("_mz"), F.count("*").alias("n"))
    centred = rows_z.join(means, by)
    dx, dy, dz = F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"), F.col("_z") - F.col("_mz")
    s = lambda a, b, name: F.sum(a * b).alias(name)
    sums = centred.groupBy(*by, "n", "_mx", "_my", "_mz").agg(s(dx, dx, "xx"), s(dx, dy, "xy"), s(dy, dy, "yy"), s(dz, dz, "zz"), s(dx, dz, "xz"), s(dz, dy, "zy"))
    c = F.col
    p = 3 if control else 2
    det = c("xx") * c("zz") - c("xz") * c("xz") if control else c("xx")
    ok = (c("n") >= 3 + (1 if control else 0)) & (det > 1e-12 * F.greatest(c("xx") * (c("zz") if control else F.lit(1.0)), F.lit(1e-300)))
    safe = F.when(ok, det)
    coef = (c("xy") * c("zz") - c("zy") * c("xz")) / safe if control else c("xy") / safe
    gamma = (c("zy") * c("xx") - c("xy") * c("xz")) / safe if control else F.lit(0.0)
    fit = sums.withColumn("coef", coef).withColumn("gamma", gamma).withColumn("intercept", c("_my") - F.col("coef") * c("_mx") - F.col("gamma") * c("_mz"))
    ssr = F.greatest(c("yy") - c("coef") * c("xy") - c("gamma") * c("zy"), F.lit(0.0))
    fit = fit.withColumn("ssr", ssr).withColumn("se", F.sqrt(c("ssr") / F.greatest(c("n") - p, F.lit(1)) * ((c("zz") / safe) if control else 1 / safe)))
    off = rows_z.join(fit.select(*by, "coef", "gamma", "intercept"), by)
    miss = off.groupBy(*by).agg(F.avg(F.abs(c(y) - c("intercept") - c("coef") * c(x) - c("gamma") * c("_z"))).alias("mae"))
    out = fit.join(miss, by)
    nan = lambda v: F.coalesce(v, F.lit(float("nan")))
    return out.select(*by, "n", nan(c("coef")).alias("coef"), nan(c("intercept")).alias("intercept"), nan(c("coef") / F.nullif(c("se"), F.lit(0.0))).alias("t_stat"),
                      nan(F.when(c("coef").isNotNull(), 1 - c("ssr") / F.nullif(c("yy"), F.lit(0.0)))).alias("r2"), nan(F.sqrt(c("ssr") / c("n"))).alias("rmse"), nan(c("mae")).alias("mae"))


def verdict(t: Column, coef: Column) -> Column:
    return F.when(F.abs(t) >= 2, F.when(coef > 0, "positive").otherwise("negative")).otherwise("inconclusive")


def summary(window: Column, n: Column, coef: Column, t: Column, r2: Column) -> Column:
    return F.format_string("%dd: n=%d coef=%.4f t=%.2f R2=%.3f", window, n, coef, t, r2)


def study_rows(docs: DataFrame, signals: DataFrame, changes: DataFrame, key: str = "doc_id") -> DataFrame:
    """(ticker, date, form, signal, disclosure_change) of every document (key, ticker, date, form).

    The signal is the document's sentiment; the change counts what differs from the version before and is null for transcripts and first versions.
    """
    rows = docs.join(signals.select(key, F.col("sentiment_score").alias("signal")), key, "left").join(changes.select(key, "changes"), key, "left")
    change = F.when(F.upper("form") != "TRANSCRIPT", F.col("changes"))
    return rows.select(key, "ticker", "date", "form", "signal", change.alias("disclosure_change"))


LABELS = ("periodic", "transcripts", "other")


def study(rows: DataFrame, by: list[str], signal: str = "signal", least: int = 0, order: tuple[str, ...] = LABELS) -> DataFrame:
    """The regression of returns on a signal by `by`, document group and window, in the groups' fixed order.

    rows: study rows with their forward returns (window, ret). Only keys with `least` documents or more that have the signal are studied.
    """
    have = rows.where(F.col(signal).isNotNull())
    if least:
        enough = have.select(*by, "doc_id").distinct().groupBy(*by).agg(F.count("*").alias("_docs")).where(F.col("_docs") >= least).select(*by)
        have = have.join(enough, by, "left_semi")
    out = ols(have.withColumn("group", group_of(F.col("form"))), [*by, "group", "window"], x=signal)
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), F.col("group")), F.lit(0)), F.lit(len(order) + 1))
    return out.withColumn("place", place)
