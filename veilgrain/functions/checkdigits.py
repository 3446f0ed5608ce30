"""Check digits of numbers, as Spark expressions; null for a null value, false for one of another shape."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights.
RRN = (2, 3, 4, 5, 6, 7, 8, 9, 2, 3, 4, 5)
BUSINESS = (1, 3, 7, 1, 3, 7, 1, 3, 5)
ROUTING = (3, 7, 1, 3, 7, 1, 3, 7, 1)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, r"[^0-9]", "")


def _digit(d: Column, i: int) -> Column:
    return F.substring(d, i + 1, 1).try_cast("int")


def _weighted(d: Column, weights: tuple[int, ...]) -> Column:
    total = F.lit(0)
    for i, w in enumerate(weights):
        total = total + _digit(d, i) * w
    return total


def luhn(value: Column) -> Column:
    """Cards: every second digit from the right doubled."""
    d = digits(value)
    return F.when(d.isNull(), None).otherwise(F.length(d).between(13, 19) & F.coalesce(F.call_function("luhn_check", d), F.lit(False)))


def rrn(value: Column) -> Column:
    """Resident numbers: eleven less the weighted sum modulo eleven, modulo ten."""
    d = digits(value)
    return (F.length(d) == 13) & F.coalesce((11 - _weighted(d, RRN) % 11) % 10 == _digit(d, 12), F.lit(False))


def business(value: Column) -> Column:
    """Business numbers of ten digits: the last weight's tens count, too."""
    d = digits(value)
    total = _weighted(d, BUSINESS) + F.floor(_digit(d, 8) * 5 / 10)
    return (F.length(d) == 10) & F.coalesce((10 - total % 10) % 10 == _digit(d, 9), F.lit(False))


def routing(value: Column) -> Column:
    """Routing numbers of nine digits with the weights 3, 7, 1."""
    d = digits(value)
    return (F.length(d) == 9) & F.coalesce(_weighted(d, ROUTING) % 10 == 0, F.lit(False))


def iban(value: Column) -> Column:
    """Account numbers whose first four characters, put last, leave one modulo 97; letters count from ten."""
    plain = F.upper(F.regexp_replace(value, r"[\s-]", ""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    rest = F.aggregate(
        F.split(turned, ""),
        F.lit(0),
        lambda a, c: F.when(F.rlike(c, F.lit("^[0-9]$")), (a * 10 + c.try_cast("int")) % 97).when(F.rlike(c, F.lit("^[A-Z]$")), (a * 100 + F.ascii(c) - 55) % 97).otherwise(a),
    )
    return F.rlike(plain, F.lit(r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$")) & (rest == 1)
