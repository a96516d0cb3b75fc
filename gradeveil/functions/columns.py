"""Small helpers for building columns."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once also where lambdas in `then` refer to it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def first_match(rules: list[tuple[Column, Column | str]], otherwise: Column | str | None = None) -> Column:
    """An ordered decision list: the result of the first rule whose condition holds."""
    value = lambda x: x if isinstance(x, Column) else F.lit(x)
    chain = reduce(lambda c, rule: c.when(rule[0], value(rule[1])), rules[1:], F.when(rules[0][0], value(rules[0][1])))
    return chain.otherwise(value(otherwise))


def violations(rules: list[tuple[Column, str]]) -> Column:
    """The codes of all rules whose condition holds, in order. A condition that is null counts as violated."""
    return F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), code) for c, code in rules)), lambda x: x.isNotNull())


def ratio(a: Column, b: Column) -> Column:
    """a / b to six decimals; null where b is 0."""
    return F.round(F.when(b != 0, a.cast("double") / b), 6)


def f1(precision: Column, recall: Column) -> Column:
    return F.when(precision.isNull() | recall.isNull(), None).when(precision + recall == 0, F.lit(0.0)).otherwise(F.round(2 * precision * recall / (precision + recall), 6))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """HMAC-SHA256 of a string column as a hex string, by sha2 of padded keys."""
    import hashlib

    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)


def luhn(digits: Column) -> Column:
    """Whether a string of ASCII digits passes the Luhn check."""
    numbers = F.reverse(F.transform(F.filter(F.split(digits, ""), lambda c: c != ""), lambda c: c.cast("int")))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return (F.length(digits) > 0) & (F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0)


def wilson(hits: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The Wilson interval of a share; null where n is 0."""
    p = hits / n
    centre = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    ok = n > 0
    return F.when(ok, F.greatest(centre - half, F.lit(0.0))), F.when(ok, F.least(centre + half, F.lit(1.0)))
