"""Text rules: text compares without case and trailing blanks.

Codes are compared all the time, in joins, groupings and filters.  They are
brought to one form when a table is taken in (``sources.ingest``), so that
Spark compares plain bytes afterwards: joins stay hash joins, groupings hash
aggregations, and a filter on a code reaches the scan.  ``KEY_COLUMNS`` names
the columns that hold codes, in whatever table they stand.  Other text is
compared by the collation ``RULE`` where a filter asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The columns that hold codes.
KEY_COLUMNS = frozenset("""
    account accounttype acctcode acctno acctnum accttype acctype actype bankcode bpcode branchcode canceled cardcode cardtype
    cheqnum chknum code commtype company comtype dbcode dcode dispatchtype empcode empid folder_id formatcode groupcode grpcode
    hosp imd_pkg_code imd_pkg_item imh_billcode imh_code imh_type invntitem itemcode itemtype labno lisgrp maxchk minchk
    pcktype pcode periodtype pid pmode prclvl pricetype ratedesc segment_0 segment_1 senior slpcode slsstat stat testgrp tg_code
    ti_test_grp u_accounttype u_acntno u_branch u_doctorcode u_labno u_location u_packageno u_paycode u_paymenttyp u_source
    voidtype whs whscode
""".split())
#: Spark's collation without case and trailing blanks.
RULE = "UTF8_LCASE_RTRIM"


def normal(value):
    """A parameter in the form codes are stored in; what is not text stays as it is."""
    return value.rstrip(" ").upper() if isinstance(value, str) else value


def everything(value) -> bool:
    """No filter: nothing given, or 'All'."""
    return value is None or normal(value) == "ALL"


def equals(column: str, value) -> Column:
    """The column equals a parameter under the text rule."""
    if not isinstance(value, str) or column in KEY_COLUMNS:
        return F.col(column) == F.lit(normal(value))
    return F.collate(F.col(column).cast("string"), RULE) == F.lit(value)


def join_key(col: Column | str) -> Column:
    """Normal form of a text key: upper case, no trailing blanks."""
    return F.upper(F.rtrim(F.col(col) if isinstance(col, str) else col))


def normalise_keys(df: DataFrame, *columns: str) -> DataFrame:
    """Bring key columns to their normal form on ingest, so joins stay plain hash joins."""
    return df.withColumns({c: join_key(c) for c in columns})


def or_blank(col: Column | str) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def is_blank(col: Column | str) -> Column:
    return or_blank(col) == ""


def clean_code(col: Column | str) -> Column:
    """Trim blanks and drop line breaks."""
    return F.translate(F.trim(F.col(col) if isinstance(col, str) else col), "\r\n", "")


def labelled(code: Column | str, text: Column | str) -> Column:
    """'code - text', NULL when either part is NULL."""
    return F.concat(F.col(code) if isinstance(code, str) else code, F.lit(" - "),
                    F.col(text) if isinstance(text, str) else text)


def optional(df: DataFrame, **wanted) -> DataFrame:
    """Keep rows equal to every given value under the text rule; ``None`` and 'All' mean no filter."""
    for column, value in wanted.items():
        if not everything(value):
            df = df.where(equals(column, value))
    return df


def holds(column: str, needle) -> Column:
    """The column contains the text; upper and lower case are the same."""
    return F.contains(F.upper(F.col(column).cast("string")), F.upper(F.lit(str(needle))))


def optional_contains(df: DataFrame, **needles) -> DataFrame:
    """Keep rows whose text contains every given value, in any case; ``None`` and 'All' mean no filter."""
    for column, value in needles.items():
        if not everything(value):
            df = df.where(holds(column, value))
    return df


def only_branches(df: DataFrame, branches, column: str = "whscode") -> DataFrame:
    """Branch filter given as one code, a list of codes, or 'All'/None; codes in any case, trailing blanks do not count."""
    if branches is None or isinstance(branches, str) and (everything(branches) or not branches.strip()):
        return df
    codes = [branches] if isinstance(branches, str) else list(branches)
    return df.where(F.col(column).isin([normal(c) for c in codes]))
