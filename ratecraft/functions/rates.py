"""Which rate a row stands for, under each of the conventions in use."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ratecraft import constants as K
from ratecraft.functions.numbers import trimmed_number_text
from ratecraft.functions.text import col

_ZERO = 0.0


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(_ZERO))


def consolidated_rate(rate_type: Column, od: Column, tp: Column, net: Column) -> Column:
    """The one rate a type implies; without a known type the first non-zero of net, OD, TP."""
    return (
        F.when(rate_type == K.ON_OD_TP, _or_zero(od) + _or_zero(tp))
        .when(rate_type == K.ON_TP, tp)
        .when(rate_type == K.ON_OD, od)
        .when(rate_type == K.ON_NET, net)
        .otherwise(F.coalesce(*[F.when(v != 0, v) for v in (net, od, tp)]))
    )


def first_positive(net: Column, od: Column, tp: Column) -> Column:
    return F.coalesce(*[F.when(v > 0, v) for v in (net, od, tp)], F.lit(_ZERO))


def effective_rate(rate_type: Column, od: Column, tp: Column, net: Column) -> Column:
    """Rate two rows of one group are compared by."""
    return F.when(rate_type == K.ON_OD_TP, _or_zero(od) + _or_zero(tp)).otherwise(first_positive(net, od, tp))


def search_rate_text(rate_type: Column, od: Column, tp: Column, net: Column) -> Column:
    """Rate as a search result shows it: ``13.00+8.00`` for a split rate."""
    split = F.concat(F.format_string("%.2f", _or_zero(od)), F.lit("+"), F.format_string("%.2f", _or_zero(tp)))
    return F.when(rate_type == K.ON_OD_TP, split).otherwise(first_positive(net, od, tp).cast("string"))


def split_rate_text(od: Column, tp: Column) -> Column:
    """``13+8``, without pointless decimals."""
    return F.concat(trimmed_number_text(od), F.lit("+"), trimmed_number_text(tp))


def _six(c: Column) -> Column:
    return F.coalesce(F.round(c, 6).cast("string"), F.lit("-"))


def payout_signature(prefix: str = "") -> Column:
    """Everything about a row's pay-out and pay-in that changes an amount, as one comparable text."""
    parts = []
    for side in ("po", "pi"):
        rate_type, od, tp, net = (col(f"{prefix}{side}_{f}") for f in ("type", "od_rate", "tp_rate", "net_rate"))
        legs = F.concat_ws("+", _six(_or_zero(od)), _six(_or_zero(tp)))
        parts += [
            F.coalesce(rate_type, F.lit("-")),
            _six(consolidated_rate(rate_type, od, tp, net)),
            F.when(rate_type == K.ON_OD_TP, legs).otherwise(F.lit("")),
        ]
    return F.concat_ws("|", *parts)


def tenure_rate(years: Column) -> Column:
    """The health rate of a 1-5 year tenure."""
    rates = F.array(*[F.col(name) for name in K.TENURE_RATES])
    return F.when(years.between(1, 5), F.try_element_at(rates, years))
