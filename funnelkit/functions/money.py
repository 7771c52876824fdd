"""Exact money: sums of ``quantity x price`` for any finite price.

A price counts as its decimal text (0.1 is a tenth, 4e-7 four ten-millionths):
an integer of at most 17 digits times a power of ten. Quantities are summed per
price first, so each price is multiplied once per group, not once per line, and
products of one power are summed as decimal(38,0). An **amount** is what such
sums give: the struct ``(t, e)`` for t x 10**e. It does not depend on the order in
which partitions are added up, nor on ANSI mode.

Rounding happens once, when an amount becomes a double (to the nearest one) or
an average (half away from zero). Where the powers of one group lie so far apart
that 38 digits cannot hold the sum, digits below the 36th are cut off.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHOLE = "decimal(38,0)"
#: digits that a sum's terms may have, so that some hundred of them still fit
_DIGITS = 35
AMOUNT = f"struct<t:{_WHOLE},e:int>"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _known(price: Column) -> Column:
    return price.isNotNull() & ~F.isnan(price) & (F.abs(price) < float("inf"))


def price_digits(price: str | Column) -> Column:
    """A price's decimal text as ``(m, e)``, m x 10**e; NULL for NULL, NaN and infinity."""
    p = _col(price).cast("double")
    parts = F.split(p.cast("string"), "E")
    number = F.split(parts[0], r"\.")
    rest = F.rtrim(number[1], F.lit("0"))
    m = F.concat(number[0], rest).cast("decimal(20,0)")
    e = F.coalesce(F.get(parts, 1).cast("int"), F.lit(0)) - F.length(rest)
    return F.when(_known(p), F.struct(m.alias("m"), e.alias("e")))


def price_product(quantity: str | Column, digits: Column) -> Column:
    """quantity x m of a price's digits (decimal(38,0)); NULL if either is missing."""
    return (_col(quantity).cast("decimal(19,0)") * digits["m"]).cast(_WHOLE)


def checked_sum(quantity: str | Column) -> Column:
    """Sum of whole numbers as a bigint; a sum beyond it fails instead of wrapping around."""
    q = _col(quantity)
    return F.when(F.abs(F.sum(q.cast("double"))) >= 9.2e18,
                  F.raise_error(F.lit("sum of quantities beyond bigint")).cast("bigint")
                  ).otherwise(F.sum(q))


def _power(k: Column) -> Column:
    return F.concat(F.lit("1"), F.repeat(F.lit("0"), k.cast("int"))).cast(_WHOLE)


def _digits(t: Column) -> Column:
    return F.length(F.abs(t).cast("string"))


def total_amount(terms: str | Column) -> Column:
    """The amount of an array of ``(e, t)``; NULL for an empty array."""
    terms = _col(terms)
    low = F.array_min(F.transform(terms, lambda x: x["e"]))
    top = F.array_max(F.transform(terms, lambda x: x["e"] + _digits(x["t"])))
    base = F.greatest(low, top - _DIGITS)

    def scaled(x: Column) -> Column:
        up, down = F.greatest(x["e"] - base, F.lit(0)), F.greatest(base - x["e"], F.lit(0))
        cut = _power(F.least(down, F.lit(37)))
        # the remainder goes first, so that the division is exact
        less = ((x["t"] - x["t"] % cut) / cut).cast(_WHOLE)
        return F.when(down == 0, (x["t"] * _power(F.least(up, F.lit(37)))).cast(_WHOLE)).when(
            down > 37, F.lit(0).cast(_WHOLE)).otherwise(less)
    total = F.aggregate(terms, F.lit(0).cast(_WHOLE), lambda acc, x: (acc + scaled(x)).cast(_WHOLE))
    return F.when(F.size(terms) > 0, F.struct(total.alias("t"), base.cast("int").alias("e")))


def money(amount: str | Column) -> Column:
    """An amount as the nearest double."""
    a = _col(amount)
    return F.concat(a["t"].cast("string"), F.lit("E"), a["e"].cast("string")).cast("double")


def average_order_value(amount: str | Column, n: str | Column) -> Column:
    """ROUND(amount / n, 2) with half away from zero, computed exactly; NULL when n <= 0.

    Whole cents are ``(2 c + n) div 2 n`` with ``c`` the amount in cents (both sides
    times a power of ten if it has smaller parts). Averages of 10**15 and more,
    whose doubles have no cents, are divided as doubles.
    """
    a, count = _col(amount), _col(n)
    finer = a["e"] + 2
    up, down = F.greatest(finer, F.lit(0)), F.greatest(-finer, F.lit(0))
    rough = money(a) / count.cast("double")
    fits = ((F.abs(rough) < 1e15) & (_digits(a["t"]) + up <= 36)
            & (F.length(count.cast("string")) + down <= 36))
    num = (F.abs(a["t"]) * _power(F.least(up, F.lit(37)))).cast(_WHOLE)
    den = (count.cast(_WHOLE) * _power(F.least(down, F.lit(37)))).cast(_WHOLE)
    cents = F.call_function("div", (num * 2 + den).cast(_WHOLE), (den * 2).cast(_WHOLE))
    exact = (F.signum(a["t"]).cast("bigint") * cents).cast("double") / F.lit(100.0)
    return F.when(count > 0, F.when(fits, exact).otherwise(F.round(rough, 2)))
