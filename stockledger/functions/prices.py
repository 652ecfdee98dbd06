"""Valuation and net purchase price."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from stockledger.functions.numbers import NET_QTY
from stockledger.schemas import PRICE


def nominal(stok: Column, harga_avg: Column, harga_beli: Column) -> Column:
    """Stock value at the average price, or at the last purchase price if there is none."""
    price = F.when(harga_avg.cast(PRICE) != 0, harga_avg.cast(PRICE)).otherwise(
        harga_beli.cast(PRICE)
    )
    return F.round(stok.cast(NET_QTY) * price, 2)


def _rate(column: Column) -> Column:
    return F.coalesce(column.cast("double"), F.lit(0.0))


def _after_percent(discount: Column) -> Column:
    return F.when(F.abs(discount) < 1, 1 - discount).otherwise(F.lit(1.0))


def _absolute(discount: Column) -> Column:
    return F.when(F.abs(discount) >= 1, discount).otherwise(F.lit(0.0))


def net_buy_price(
    harga_beli: Column,
    line_discounts: list[Column],
    header_discounts: list[Column],
    pajak: Column,
    ppnbm: Column,
    factor: Column,
) -> Column:
    """Price of one smallest unit after discounts and taxes, as a double.

    A discount below 1 in magnitude is a fraction of the price; from 1 on it is an
    amount, taken off the line price once all fractions are applied. Header amounts
    do not count. The price is 0 for a zero factor or a non-positive line price.
    """
    line = [_rate(d) for d in line_discounts]
    header = [_rate(d) for d in header_discounts]
    price = harga_beli.cast("double")
    price = reduce(lambda p, d: p * _after_percent(d), line, price)
    price = reduce(lambda p, d: p - _absolute(d), line, price)
    price = F.when(harga_beli <= 0, F.lit(0.0)).otherwise(price)
    price = reduce(lambda p, d: p * _after_percent(d), header, price)
    price = price * (1 + _rate(pajak)) * (1 + _rate(ppnbm))
    factor = factor.cast("double")
    return F.when(factor == 0, F.lit(0.0)).otherwise(price / factor)
