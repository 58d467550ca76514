"""Column expressions shared by the operators. All are built-in Spark functions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(15, 2)
MONEY_SUM = DecimalType(28, 2)
RATE = DecimalType(6, 4)

# Fixed value: the e-mail pattern of the partner check (lower case only, endings of 2 to 4 letters).
EMAIL_PATTERN = r"^[_a-z0-9-]+(\.[_a-z0-9-]+)*@[a-z0-9-]+(\.[a-z0-9-]+)*(\.[a-z]{2,4})$"


def as_date(value: dt.date | str) -> Column:
    return F.lit(value).cast("date")


def percent_of(amount: Column, percent: Column) -> Column:
    """amount x percent / 100, exact in decimals."""
    return amount * percent * F.lit("0.01").cast(DecimalType(3, 2))


def small_number(text: Column) -> Column:
    """Number of one to three digits from text; NULL for anything else."""
    return F.try_to_number(text, F.lit("999")).cast("int")


def plain_ruc(ruc: Column) -> Column:
    """RUC without dashes and spaces."""
    return F.translate(ruc, "- ", "")


def whole_years(birth: Column, as_of: Column) -> Column:
    return F.floor(F.months_between(as_of, birth) / 12).cast("int")


def day_month_year(moment: Column) -> Column:
    return F.date_format(moment, "dd/MM/yyyy")


def two_decimals(amount: Column) -> Column:
    """Amount as text with two decimals."""
    return amount.cast(MONEY).cast("string")


def zero_padded(number: Column, width: int) -> Column:
    """Number padded to at least `width` digits; longer numbers stay whole."""
    text = number.cast("string")
    return F.lpad(text, F.greatest(F.lit(width), F.length(text)), F.lit("0"))


def is_blank(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit("")) == ""
