"""Checksums of Turkish identity, tax and bank numbers as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digit(x: Column, i: int) -> Column:
    return F.substring(x, i, 1).cast("int")


def _guarded(ok: Column, x: Column, safe: str, check) -> Column:
    """check of x where ok, else false; ANSI casts never see another shape."""
    return ok & check(F.when(ok, x).otherwise(safe))


def valid_tckn(x: Column) -> Column:
    def check(v: Column) -> Column:
        d = [_digit(v, i) for i in range(1, 12)]
        tenth = F.pmod((d[0] + d[2] + d[4] + d[6] + d[8]) * 7 - (d[1] + d[3] + d[5] + d[7]), F.lit(10))
        return (tenth == d[9]) & (sum(d[1:10], d[0]) % 10 == d[10])

    return _guarded(x.rlike("^[1-9][0-9]{10}$"), x, "0" * 11, check)


def valid_vkn(x: Column) -> Column:
    def check(v: Column) -> Column:
        total = F.lit(0)
        for i in range(9):
            t = (_digit(v, i + 1) + 9 - i) % 10
            scaled = (t * 2 ** (9 - i)) % 9
            total = total + F.when(t == 0, 0).when(scaled == 0, 9).otherwise(scaled)
        return (10 - total % 10) % 10 == _digit(v, 10)

    return _guarded(x.rlike("^[0-9]{10}$"), x, "0" * 10, check)


def valid_iban_tr(x: Column) -> Column:
    """Blanks don't count; a letter after the country's would make it no Turkish IBAN."""
    plain = F.upper(F.replace(x, F.lit(" "), F.lit("")))
    return _guarded(plain.rlike("^TR[0-9]{24}$"), plain, "TR" + "0" * 24, lambda v: F.concat(F.substring(v, 5, 22), F.lit("2927"), F.substring(v, 3, 2)).cast("decimal(38,0)") % 97 == 1)
