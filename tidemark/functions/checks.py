"""Check digits of Australian and New Zealand numbers, as column expressions over any text: its digits alone are looked at.

`passes_x` asks for a whole number of the kind; `x_digit` for the check digit alone, whatever the number's length and range.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The weights of each kind of number.
TFN = [1, 4, 3, 7, 5, 8, 6, 9, 10]
ABN = [10, 1, 3, 5, 7, 9, 11, 13, 15, 17, 19]
ACN = [8, 7, 6, 5, 4, 3, 2, 1]
MEDICARE = [1, 3, 7, 9, 1, 3, 7, 9]
IRD = [3, 2, 7, 6, 5, 4, 3, 2]
IRD_SECOND = [7, 4, 3, 2, 5, 2, 7, 6]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _weighted(digits: Column, weights: list[int]) -> Column:
    """Sum of the first digits times their weights; digits that are missing count nothing."""
    terms = [F.coalesce(F.substring(digits, i + 1, 1).try_cast("int"), F.lit(0)) * w for i, w in enumerate(weights)]
    return sum(terms[1:], terms[0])


def tfn_digit(value: Column) -> Column:
    return _weighted(_digits(value), TFN) % 11 == 0


def passes_tfn(value: Column) -> Column:
    return (F.length(_digits(value)) == 9) & tfn_digit(value)


def abn_digit(value: Column) -> Column:
    """The first digit counts one less."""
    return (_weighted(_digits(value), ABN) - ABN[0]) % 89 == 0


def passes_abn(value: Column) -> Column:
    return (F.length(_digits(value)) == 11) & abn_digit(value)


def acn_digit(value: Column) -> Column:
    d = _digits(value)
    return (10 - _weighted(d, ACN) % 10) % 10 == F.substring(d, 9, 1).try_cast("int")


def passes_acn(value: Column) -> Column:
    return (F.length(_digits(value)) == 9) & acn_digit(value)


def medicare_digit(value: Column) -> Column:
    d = _digits(value)
    return _weighted(d, MEDICARE) % 10 == F.substring(d, 9, 1).try_cast("int")


def passes_medicare(value: Column) -> Column:
    """10 or 11 digits, the first of them from 2 to 6."""
    d = _digits(value)
    return F.length(d).isin(10, 11) & F.substring(d, 1, 1).between("2", "6") & medicare_digit(value)


def ird_digit(value: Column) -> Column:
    """A check digit of 10 calls for the second weights."""
    d = _digits(value)
    size = F.length(d)
    base, last = F.lpad(F.substr(d, F.lit(1), size - 1), 8, "0"), F.substr(d, size, F.lit(1))
    first, second = ((11 - _weighted(base, w) % 11) % 11 for w in (IRD, IRD_SECOND))
    return F.when(first == 10, second).otherwise(first) == last.try_cast("int")


def passes_ird(value: Column) -> Column:
    """8 or 9 digits, from 10 to 200 millions."""
    d = _digits(value)
    n = F.try_to_number(F.lpad(d, 9, "0"), F.lit("999999999"))
    return F.length(d).isin(8, 9) & n.between(10_000_000, 200_000_000) & ird_digit(value)


def passes_nhi(value: Column) -> Column:
    """Three letters other than I and O, then four digits; white space and case don't matter."""
    v = F.upper(F.regexp_replace(value, r"\s", ""))
    worth = lambda i: F.coalesce(F.substring(v, i + 1, 1).try_cast("int"), F.instr(F.lit("ABCDEFGHJKLMNPQRSTUVWXYZ"), F.substring(v, i + 1, 1)))
    rest = sum((worth(i) * (7 - i) for i in range(1, 6)), worth(0) * 7) % 11
    return v.rlike("^[A-HJ-NP-Z]{3}[0-9]{4}$") & (rest != 0) & ((11 - rest) % 10 == F.substring(v, 7, 1).try_cast("int"))
