"""Statements by period: facts to periods, ratios, growth, flags, trends, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: fields and their tags by priority
TAGS = {
    "revenue": ("RevenueFromContractWithCustomerExcludingAssessedTax", "Revenues", "SalesRevenueNet"),
    "cost_of_revenue": ("CostOfGoodsAndServicesSold", "CostOfRevenue", "CostOfSales"),
    "operating_income": ("OperatingIncomeLoss",),
    "net_income": ("NetIncomeLoss",),
    "total_assets": ("Assets",),
    "total_equity": ("StockholdersEquity", "StockholdersEquityIncludingPortionAttributableToNoncontrollingInterest"),
    "total_debt": ("LongTermDebt", "LongTermDebtNoncurrent"),
    "cash": ("CashAndCashEquivalentsAtCarryingValue",),
    "current_assets": ("AssetsCurrent",),
    "current_liabilities": ("LiabilitiesCurrent",),
    "operating_cash_flow": ("NetCashProvidedByUsedInOperatingActivities",),
    "capex": ("PaymentsToAcquirePropertyPlantAndEquipment",),
    "interest_expense": ("InterestExpense", "InterestExpenseDebt"),
}
RATIOS = ("gross_margin", "operating_margin", "net_margin", "current_ratio", "debt_to_equity", "roe", "roa", "asset_turnover", "fcf", "fcf_margin", "interest_coverage")
GROWTH = ("revenue", "operating_income", "net_income", "operating_cash_flow")


def over(a: Column, b: Column) -> Column:
    """a / b, null if either is null or b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def ratios(statements: DataFrame) -> DataFrame:
    """The statements with their 11 ratios; one projection."""
    c = F.col
    gross, fcf = c("revenue") - c("cost_of_revenue"), c("operating_cash_flow") - F.abs("capex")
    made = {
        "gross_margin": over(gross, c("revenue")), "operating_margin": over(c("operating_income"), c("revenue")), "net_margin": over(c("net_income"), c("revenue")),
        "current_ratio": over(c("current_assets"), c("current_liabilities")), "debt_to_equity": over(c("total_debt"), c("total_equity")), "roe": over(c("net_income"), c("total_equity")),
        "roa": over(c("net_income"), c("total_assets")), "asset_turnover": over(c("revenue"), c("total_assets")), "fcf": fcf, "fcf_margin": over(fcf, c("revenue")), "interest_coverage": over(c("operating_income"), c("interest_expense")),
    }
    return statements.withColumns(made)


def _by_period(key: str) -> Window:
    return Window.partitionBy(key).orderBy("period")


def growth(statements: DataFrame, key: str = "entity") -> DataFrame:
    """The statements with growth over the period before; null from a base that isn't positive."""
    before = lambda f: F.lag(f).over(_by_period(key))
    return statements.withColumns({f"{f}_growth": F.when(before(f) > 0, F.col(f) / before(f) - 1) for f in GROWTH})


def flags(statements: DataFrame, key: str = "entity") -> DataFrame:
    """(key, severity, metric, rule) of each entity's latest period."""
    rows = growth(ratios(statements), key)
    w = _by_period(key)
    rows = rows.withColumns({"g1": F.lag("revenue_growth").over(w), "m1": F.lag("operating_margin", 1).over(w), "m2": F.lag("operating_margin", 2).over(w)})
    latest = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("period")))).where("place = 1")
    c = F.col

    def flag(when: Column, severity, metric: str, rule) -> Column:
        as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.when(when, F.struct(as_col(severity).alias("severity"), F.lit(metric).alias("metric"), as_col(rule).alias("rule")))

    def banded(value: Column, red: Column, amber: Column, texts: tuple[str, str, str], metric: str) -> Column:
        pick = lambda a, b, x: F.when(red, a).when(amber, b).otherwise(x)
        return flag(value.isNotNull(), pick("red", "amber", "green"), metric, pick(*texts))

    found = F.array(
        banded(c("current_ratio"), c("current_ratio") < 1.0, c("current_ratio") < 1.2, ("current_ratio < 1.0", "1.0 <= current_ratio < 1.2", "current_ratio >= 1.2"), "current_ratio"),
        banded(c("debt_to_equity"), c("debt_to_equity") > 2.0, c("debt_to_equity") > 1.0, ("debt_to_equity > 2.0", "1.0 < debt_to_equity <= 2.0", "debt_to_equity <= 1.0"), "debt_to_equity"),
        flag(c("interest_coverage") < 3.0, F.when(c("interest_coverage") < 1.5, "red").otherwise("amber"), "interest_coverage", "interest_coverage < 3.0"),
        flag(c("fcf").isNotNull(), F.when(c("fcf") < 0, "red").otherwise("green"), "fcf", F.when(c("fcf") < 0, "fcf < 0").otherwise("fcf >= 0")),
        flag((c("net_income") > 0) & (c("operating_cash_flow") < 0.5 * c("net_income")), "amber", "earnings_quality", "ocf < 0.5 * net_income while net_income > 0"),
        flag((c("revenue_growth") < 0) & (c("g1") < 0), "red", "revenue_trend", "revenue YoY < 0 twice in a row"),
        flag((c("m2") > c("m1")) & (c("m1") > c("operating_margin")), "amber", "margin_trend", "operating_margin strictly decreasing over 3 periods"),
    )
    return latest.select(key, F.inline(F.filter(found, lambda x: x.isNotNull())))


def verdict(flagged: DataFrame, key: str = "entity") -> DataFrame:
    """(key, reds, verdict): weak from two red flags, moderate with one, else strong."""
    reds = flagged.groupBy(key).agg(F.count_if(F.col("severity") == "red").alias("reds"))
    return reds.withColumn("verdict", F.when(F.col("reds") >= 2, "weak").when(F.col("reds") == 1, "moderate").otherwise("strong"))


def long_ratios(statements: DataFrame, key: str = "entity") -> DataFrame:
    """(key, period, metric, value)."""
    return ratios(statements).unpivot([key, "period"], list(RATIOS), "metric", "value")


def trend(values: DataFrame, key: str = "entity", tolerance: float = 0.0, short: str = "—") -> DataFrame:
    """(key, metric, trend) from the last against the first value of (key, period, metric, value); nulls don't count."""
    ends = values.where("value is not null").groupBy(key, "metric").agg(F.min_by("value", "period").alias("first"), F.max_by("value", "period").alias("last"), F.count("*").alias("n"))
    moved = F.col("last") - F.col("first")
    named = F.when(F.col("n") < 2, short).when(moved > tolerance, "improving").when(moved < -tolerance, "declining").otherwise("stable")
    return ends.select(key, "metric", named.alias("trend"))


def formatted(metric: Column, value: Column) -> Column:
    """Percent for margins and returns, grouped thousands for cash, two decimals else."""
    percent = metric.rlike("margin$|^ro[ea]$")
    return F.when(value.isNull(), "—").when(percent, F.format_string("%.1f%%", value * 100)).when(metric == "fcf", F.format_number(value, 0)).otherwise(F.format_string("%.2f", value))


def latest_filed(facts: DataFrame, key: str = "entity", most: int = 4) -> DataFrame:
    """Periods from facts (key, tag, fy, fp, form, val, filed, pos).

    A field takes its first tag that has any annual row; of a year's values the one filed last counts, the first of
    equals. The last `most` years of an entity stay, as FY labels; what is missing is null.
    """
    rows = [(field, tag, i) for field, tags in TAGS.items() for i, tag in enumerate(tags)]
    tagged = F.create_map(*[F.lit(x) for field, tag, i in rows for x in (tag, f"{i}:{field}")])
    annual = facts.where("form = '10-K' and fp = 'FY' and fy is not null and val is not null").withColumn("pf", F.element_at(tagged, F.col("tag"))).where("pf is not null")
    annual = annual.withColumn("priority", F.substring_index("pf", ":", 1).cast("int")).withColumn("field", F.substring_index("pf", ":", -1))
    chosen = annual.withColumn("least", F.min("priority").over(Window.partitionBy(key, "field"))).where("priority = least")
    newest = Window.partitionBy(key, "field", "fy").orderBy(F.desc("filed"), "pos")
    valued = chosen.withColumn("place", F.row_number().over(newest)).where("place = 1")
    wide = valued.groupBy(key, "fy").pivot("field", list(TAGS)).agg(F.first("val"))
    kept = wide.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("fy")))).where(F.col("place") <= most)
    return kept.select(key, F.concat(F.lit("FY"), F.col("fy").cast("string")).alias("period"), *TAGS)


def company_facts(raw: Column) -> Column:
    """array<struct<tag, fy, fp, form, val, filed, pos>> of a company-facts JSON text, US dollars only."""
    kind = "struct<facts:map<string,map<string,struct<units:map<string,array<struct<fy:int,fp:string,form:string,val:double,filed:string>>>>>>>"
    tags = F.map_entries(F.try_element_at(F.from_json(raw, kind)["facts"], F.lit("us-gaap")))
    rows = F.transform(tags, lambda t: F.transform(F.coalesce(F.try_element_at(t["value"]["units"], F.lit("USD")), F.array().cast("array<struct<fy:int,fp:string,form:string,val:double,filed:string>>")), lambda f, i: F.struct(t["key"].alias("tag"), f["fy"].alias("fy"), f["fp"].alias("fp"), f["form"].alias("form"), f["val"].alias("val"), f["filed"].alias("filed"), i.alias("pos"))))
    return F.flatten(rows)


# fixed values: fields and the labels they have in statements as published by data vendors, by priority
LABELS = {
    "revenue": ("Total Revenue",), "cost_of_revenue": ("Cost Of Revenue",), "operating_income": ("Operating Income",), "net_income": ("Net Income",), "interest_expense": ("Interest Expense",),
    "total_assets": ("Total Assets",), "total_equity": ("Stockholders Equity", "Total Equity Gross Minority Interest"), "total_debt": ("Total Debt",), "cash": ("Cash And Cash Equivalents",),
    "current_assets": ("Current Assets",), "current_liabilities": ("Current Liabilities",), "operating_cash_flow": ("Operating Cash Flow",), "capex": ("Capital Expenditure",),
}


def from_statements(lines: DataFrame, most: int = 4, key: str = "entity") -> DataFrame:
    """Periods from statement lines (key, label, date, value), one row for a label and date; the last `most` dates, oldest first by year.

    A field takes the first of its labels that the entity has at all, NaN is null, and dates are those of the revenue statement (label "Total
    Revenue" or another of its lines).
    """
    rows = [(field, label, i) for field, labels in LABELS.items() for i, label in enumerate(labels)]
    named = F.create_map(*[F.lit(x) for field, label, i in rows for x in (label, f"{i}:{field}")])
    known = lines.withColumn("pf", F.try_element_at(named, F.col("label"))).where("pf is not null")
    known = known.withColumn("priority", F.substring_index("pf", ":", 1).cast("int")).withColumn("field", F.substring_index("pf", ":", -1))
    first = known.groupBy(key, "field").agg(F.min("priority").alias("priority"))
    chosen = known.join(first, [key, "field", "priority"])
    wide = chosen.groupBy(key, "date").pivot("field", list(LABELS)).agg(F.first(F.nanvl("value", F.lit(None).cast("double"))))
    kept = wide.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("date")))).where(F.col("place") <= most)
    return kept.select(key, F.year("date").cast("string").alias("period"), *LABELS)


def pivoted(values: DataFrame, by: list[str], column: str, value: Column, spark_limit: int = 10_000) -> DataFrame:
    """A table with a column for each value of `column` that occurs, in order; their number is checked, not assumed."""
    found = [r[0] for r in values.select(column).distinct().orderBy(column).limit(spark_limit + 1).collect()]
    if len(found) > spark_limit:
        raise ValueError(f"more than {spark_limit} columns")
    return values.groupBy(*by).pivot(column, found).agg(value)
