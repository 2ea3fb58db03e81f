"""Queries over untidy codes: the same rows as over tidy ones.

``untidy`` gives every code of every table, row by row, another spelling: lower
case, trailing blanks, both or neither.  Taken in by the text rule they must
give the results of the tidy tables, so the twins are those of the queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import KEY_COLUMNS
from ..operators import masters, review
from ..sources.ingest import tidied
from ..sources.tables import Tables
from . import budget, changes, commission, rating  # noqa: F401  (the queries named below)
from . import review as _review  # noqa: F401
from .registry import CATALOGUE, register
from .results_sql import sum2


def spelled_anew(df: DataFrame) -> DataFrame:
    """Every code in one of four spellings, by a hash of its row."""
    codes = [c for c, kind in df.dtypes if c in KEY_COLUMNS and kind == "string"]
    how = lambda n: F.pmod(F.xxhash64(F.lit(n), *[F.col(c) for c, kind in df.dtypes if not kind.startswith("map")]), F.lit(4))
    spelled = lambda c, n: F.when(how(n) == 0, F.lower(c)).when(how(n) == 1, F.concat(F.col(c), F.lit("  "))).when(
        how(n) == 2, F.concat(F.lower(c), F.lit(" "))).otherwise(F.col(c))
    return df.select(*[spelled(c, n).alias(c) if c in codes else F.col(c) for n, c in enumerate(df.columns)])


def untidy(t: Tables) -> Tables:
    return Tables(lambda name: spelled_anew(t[name]))


#: Joins, groupings and anti joins on codes of every kind.
UNDER_THE_RULE = [
    "rebate_eligible_lines", "rate_combination_key", "rebate_exclusions", "credit_memo_net", "installment_paid", "payee_sharing_split",
    "asof_rep_assignment", "commission_generation_skip_marked", "rebates_by_branch", "rebates_detail", "budget_gate", "payment_lines", "unassigned_employees",
    "insert_if_absent", "special_test_set"]

for _name in UNDER_THE_RULE:
    register(f"text_rule_{_name}", lambda t, name=_name: CATALOGUE[name].build(tidied(untidy(t))), CATALOGUE[_name].sql)


def by_codes(t):
    """Tagging intervals of one clinician, asked for in another spelling."""
    u = tidied(untidy(t))
    return masters.rep_tag_history(u.odrs, u.bpslp, u.oslp, code="d7  ")


register("text_rule_optional", by_codes,
         """select d.dcode, d.dname, b.slpcode, upper(o.slpname) slpname, b.sdate, b.edate, b.encodedate from fx_odrs d
         left join fx_bpslp b on b.bpcode = d.dcode and b.stype = 102 left join fx_oslp o on o.slpcode = b.slpcode where d.dcode = 'D7'""")


def by_branches(t):
    """Open totals of some branches, named with trailing blanks."""
    u = tidied(untidy(t))
    return review.payee_rebates(u.rac_rbdetailstrans, u.rb_payees, u.oslp, branches=["003 ", "011", "020   "]).select("genid", "u_paycode", "rebatesamnt").distinct()


register("text_rule_only_branches", by_branches,
         f"""select genid, u_paycode, {sum2('rebatesamnt')} rebatesamnt from st_detail where whscode in ('003', '011', '020') and stat = 0 group by 1, 2""")
