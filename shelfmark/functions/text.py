"""Text conforming, as native column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mail hosts whose missing "@" can be put back, in search order.
EMAIL_HOSTS = ("gmail.com", "outlook.com", "yahoo.com", "hotmail.com", "icloud.com")

_MARK = "\x01 "


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest.

    ``initcap`` starts a new word at a blank only, so a marked blank is put after
    every other non-letter that a letter follows, and taken out again
    ("esch-sur-alzette" -> "Esch-Sur-Alzette"). All three steps are compiled.
    """
    marked = F.regexp_replace(text, r"(?<=[^\p{L} ])(?=\p{L})", _MARK)
    return F.replace(F.initcap(marked), F.lit(_MARK), F.lit(""))


def strip(text: Column) -> Column:
    """Remove white space (Unicode included) at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def plain_address(email: Column) -> Column:
    return F.lower(strip(email))


def with_at_sign(address: Column, hosts: tuple[str, ...] = EMAIL_HOSTS) -> Column:
    """Put the missing "@" before each occurrence of the first host found."""
    mended = reduce(
        lambda otherwise, host: F.when(
            address.contains(host), F.replace(address, F.lit(host), F.lit("@" + host))
        ).otherwise(otherwise),
        reversed(hosts),
        address,
    )
    return F.when(address.contains("@"), address).otherwise(mended)


def usable_address(address: Column) -> Column:
    """The address if its part between the first and second "@" has a dot, else NULL."""
    return F.when(F.split_part(address, F.lit("@"), F.lit(2)).contains("."), address)
