"""Deal economics: cost rules, scenarios, and the highest purchase price that meets the limits."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scenario name, renovation percent, days percent, which exit value.
SCENARIOS = [("DOWNSIDE", 120, 125, "low"), ("BASE", 100, 100, "base"), ("UPSIDE", 90, 75, "high")]
RULES = ("taxes", "notary", "lawyer", "agency", "sale", "holding", "financing", "other")
MONEY = "decimal(18,2)"


def money(x: Column) -> Column:
    return F.round(x.cast("decimal(38,10)"), 2).cast(MONEY)


def in_cents(x: Column) -> Column:
    """Whole cents of an amount, half up."""
    return F.round(x.cast("decimal(20,4)") * 100).cast("long")


def rule_cents(rule: dict[str, object], price: Column, exit_value: Column, days: Column) -> Column:
    """fixed + price_pct percent of the price + exit_pct percent of the exit + per_day, in whole cents; price
    and exit are in cents too. Values may be numbers or columns; what a rule lacks is 0.

    Everything is a long of 1/1,000,000 cent until it is rounded, which compiles to plain arithmetic."""
    unknown = set(rule) - {"fixed", "price_pct", "exit_pct", "per_day"}
    if unknown:
        raise ValueError(f"unknown cost rule keys: {sorted(unknown)}")

    def units(k: str, scale: int) -> Column | None:
        """A rule's value in units of 1/scale; None for what adds nothing."""
        v = rule.get(k, 0)
        if isinstance(v, Column):
            return F.round(v.cast("decimal(14,4)") * scale).cast("long")
        whole = int((Decimal(str(v)) * scale).to_integral_value(ROUND_HALF_UP))
        return F.lit(whole).cast("long") if whole else None

    parts = [(units("fixed", 100_000_000), None), (units("price_pct", 10_000), price), (units("exit_pct", 10_000), exit_value), (units("per_day", 100_000_000), days.cast("long"))]
    terms = [u if by is None else u * by for u, by in parts if u is not None]
    total = reduce(lambda x, y: x + y, terms, F.lit(0).cast("long"))
    return F.call_function("div", 2 * total + 1_000_000, F.lit(2_000_000).cast("long"))


def economics_cents(price: Column, exit_value: Column, renovation: Column, days: Column, reserve: Column, rules: dict[str, dict]) -> dict[str, Column]:
    """Basis, net and profit of one scenario, all in whole cents."""
    cost = {name: rule_cents(rules[name], price, exit_value, days) for name in RULES if rules.get(name)}
    spent = reduce(lambda a, b: a + b, (c for name, c in cost.items() if name != "sale"), F.lit(0).cast("long"))
    basis = price + spent + renovation + reserve
    net = exit_value - cost["sale"] if "sale" in cost else exit_value
    return {"basis": basis, "net": net, "profit": net - basis}


def economics(price: Column, exit_value: Column, renovation: Column, days: Column, reserve: Column, rules: dict[str, dict]) -> dict[str, Column]:
    """Basis, net, profit, roi and its annual rate, capital days of one scenario, from and to amounts."""
    whole = economics_cents(in_cents(price), in_cents(exit_value), in_cents(renovation), days, in_cents(reserve), rules)
    basis, net, profit = ((whole[k] / 100).cast(MONEY) for k in ("basis", "net", "profit"))
    roi = F.when(basis > 0, F.round(profit / basis, 6))
    return {
        "basis": basis, "net": net, "profit": profit, "roi": roi,
        "annual_roi": F.when(days > 0, F.round(roi * 365 / days, 6)), "capital_days": money(basis * days),
        "profit_per_capital_day": F.when((basis > 0) & (days > 0), F.round(profit.cast("decimal(38,12)") / (basis * days), 10)),
    }


def scenario_rows(deals: DataFrame, cents: bool = False) -> DataFrame:
    """Each deal three times: scenario, and its renovation, days (half up) and exit; cents: amounts are whole cents."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("scenario"), F.lit(r).alias("_r"), F.lit(d).alias("_d"), F.col(f"exit_{x}").alias("exit_value")) for n, r, d, x in SCENARIOS)))
    out = deals.withColumn("_s", each).select("*", "_s.*").drop("_s")
    scaled = out.withColumn("scenario_renovation", F.expr("(renovation * _r + 50) div 100") if cents else money(F.col("renovation") * F.col("_r") / 100))
    return scaled.withColumn("scenario_days", F.round((F.col("days") * F.col("_d")).cast("decimal(14,2)") / 100).cast("int")).drop("_r", "_d")


def max_buy_cents(exit_cents: Column, fits) -> Column:
    """The largest whole-cent price up to the exit for which fits(cents) holds; 0 if one cent fails.
    fits must fail for all prices above the first that fails. A binary search in whole
    cents, a step for each bit of the exit, inside one expression: no rows, no Python."""
    mid = lambda s: F.floor((s["lo"] + s["hi"] + 1) / 2)
    halves = lambda s, m: F.when(fits(m), F.struct(m.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), (m - 1).alias("hi")))
    step = lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(halves(s, mid(s)))
    start = F.struct(F.lit(0).cast("long").alias("lo"), exit_cents.cast("long").alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.length(F.bin(exit_cents.cast("long"))) + 1), start, step, lambda s: s["lo"])


def max_buy_linear(exit_cents: Column, net: Column, fixed: Column, pcts: list[Column], min_profit: Column, min_roi: Column) -> Column:
    """max_buy_cents for costs that are linear in the price, without a search: the basis is the price, fixed
    cents, and each of pcts (in 1/10,000 percent) of the price in whole cents, half up. What it may be follows
    from both limits (min_roi in 1/1,000,000); dividing that by the slope is right but for the roundings,
    half a cent for each percentage, so the few prices around are tried."""
    div = lambda a, b: F.call_function("div", a, b.cast("long"))
    million = F.lit(1_000_000).cast("long")
    most = F.least(net - min_profit, F.floor(net.cast("decimal(20,0)") * million / (million + min_roi)).cast("long"))
    slope = reduce(lambda a, b: a + b, pcts, million)
    about = div((most - fixed).cast("long") * million, slope)
    basis = lambda c: reduce(lambda a, p: a + div(2 * c * p + million, 2 * million), pcts, c + fixed)
    reach = len(pcts) // 2 + 1
    tried = [F.greatest(F.lit(0), F.least(exit_cents, about + k)) for k in range(-reach, reach + 1)]
    return F.greatest(F.lit(0).cast("long"), *(F.when(basis(c) <= most, c).otherwise(0) for c in tried))


def meets(min_profit: Column, min_roi: Column):
    """The predicate of the solver on cents: profit >= min_profit and profit >= min_roi * basis."""

    def of(profit: Column, basis: Column) -> Column:
        return (profit >= min_profit) & (profit >= min_roi * basis)

    return of


def required_negotiation(asking: Column, max_buy: Column) -> tuple[Column, Column]:
    amount = F.greatest(asking - max_buy, F.lit(0))
    return amount, F.when(asking > 0, F.round((amount / asking).cast("decimal(20,10)"), 6))


def missing_reason(known: list[tuple[str, Column]]) -> Column:
    """The first name whose input is not known, in order."""
    return reduce(lambda o, k: F.when(~k[1], k[0]).otherwise(o), reversed(known), F.lit(None).cast("string"))
