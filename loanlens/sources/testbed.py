"""Loan and application columns derived from the test tables.

Each column is one expression that Spark SQL and the checking SQL both understand, so a query and
its check start from the same rows. Only the tables the requested columns need are joined: order,
customer, nation, region and part keys are declared unique and complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOAN_ID = (
    "concat_ws('-', cast(l_orderkey as string), cast(l_linenumber as string), "
    "cast(l_partkey as string), cast(l_suppkey as string))"
)
STATUS = (
    "case when l_returnflag = 'N' and l_linestatus = 'F' then 'CANCLD' "
    "when l_returnflag = 'N' then 'EXEMPT' "
    "when (l_orderkey * 7 + l_linenumber * 13 + l_partkey * 3) % 100 < 4 + l_quantity * 0.4e0 "
    "then 'CHGOFF' else 'P I F' end"
)
BAD_LOSS = "(l_extendedprice * (0.5e0 + l_discount))"
GUARANTEED = "(l_extendedprice * (0.5e0 + l_tax * 5e0))"
RESOLVED_ON = "case when l_returnflag <> 'N' then cast(l_shipdate as date) end"
BUSINESS_AGE = (
    "case when year(o_orderdate) >= 1999 and p_size > 10 then 'NEW-OLDER' "
    "when p_size > 40 then 'OLD-5PLUS' when p_size > 25 then 'OLD-3TO5' "
    "when p_size > 10 then 'OLD-2TO3' else 'STARTUP' end"
)
IS_DENIED = (
    "case when (l_orderkey * 11 + l_partkey * 5 + l_linenumber) % 100 "
    "< 15 + case when c_mktsegment = 'BUILDING' then 12 else 0 end "
    "+ case when year(o_orderdate) >= 1999 then 5 else 0 end then 1 else 0 end"
)
SCORE_A = "round(0.02e0 + l_quantity * 0.004e0, 6)"
SCORE_B = "round(0.02e0 + l_quantity * 0.0035e0 + l_discount * 0.2e0, 6)"

O, C, N, R, P = "orders", "customer", "nation", "region", "part"

COLUMNS: dict[str, tuple[str, tuple[str, ...]]] = {
    "loan_id": (LOAN_ID, ()),
    "approval_fy": ("cast(year(o_orderdate) as int)", (O,)),
    "approved_on": ("cast(o_orderdate as date)", (O,)),
    "status": (STATUS, ()),
    "resolved_on": (RESOLVED_ON, ()),
    "gross_approval": ("l_extendedprice", ()),
    "guaranteed": (GUARANTEED, ()),
    "initial_rate": ("(4e0 + l_discount * 40e0)", ()),
    "jobs_supported": ("l_quantity", ()),
    "loss_if_bad": (BAD_LOSS, ()),
    "processing_method": ("o_orderpriority", (O,)),
    "collateral_ind": ("l_linestatus", ()),
    "business_age": (BUSINESS_AGE, (O, P)),
    "county_code": ("n_name", (O, C, N)),
    "region": ("r_name", (O, C, N, R)),
    "segment": ("c_mktsegment", (O, C)),
    "loan_purpose": ("l_returnflag", ()),
    "lien_status": ("l_linestatus", ()),
    "income": ("c_acctbal", (O, C)),
    "is_denied": (IS_DENIED, (O, C)),
    "is_bad": (f"case when ({STATUS}) = 'CHGOFF' then 1 else 0 end", ()),
    "score_a": (SCORE_A, ()),
    "score_b": (SCORE_B, ()),
    "split": (
        "case when year(o_orderdate) between 1995 and 1997 then 'train' "
        "when year(o_orderdate) = 1998 then 'valid' "
        "when year(o_orderdate) between 1999 and 2000 then 'test' end", (O,)),
    # raw loan file, every field text; the names are those of the public file
    "LoanNumber": (LOAN_ID, ()),
    "LoanStatus": (f"case when l_linenumber % 2 = 0 then concat('  ', {STATUS}, ' ') else {STATUS} end", ()),
    "GrossChargeOffAmount": (
        f"case when ({STATUS}) = 'CHGOFF' then cast({BAD_LOSS} as string) else '0' end", ()),
    "ApprovalFY": (
        "case when l_partkey % 211 = 0 then 'unknown' else cast(cast(year(o_orderdate) as int) as string) end", (O,)),
    "GrossApproval": (
        "case when l_partkey % 97 = 0 then 'NA' when l_partkey % 89 = 0 then '0' "
        "else cast(l_extendedprice as string) end", ()),
    "SBAGuaranteedApproval": (f"cast({GUARANTEED} as string)", ()),
    "InitialInterestRate": ("case when l_discount = 0 then 'NA' else cast((4e0 + l_discount * 40e0) as string) end", ()),
    "JobsSupported": ("cast(cast(l_quantity as int) as string)", ()),
    "NaicsCode": ("concat(' ', cast(110000 + (l_partkey * 7919) % 800000 as string))", ()),
    "FranchiseCode": ("case when l_suppkey % 5 = 0 then concat('F', cast(l_suppkey as string)) when l_suppkey % 5 = 1 then '  ' end", ()),
    "BusinessType": ("case when l_suppkey % 3 = 0 then 'CORPORATION' when l_suppkey % 3 = 1 then 'INDIVIDUAL' else ' PARTNERSHIP ' end", ()),
    "BusinessAge": (BUSINESS_AGE, (O, P)),
    "RevolverStatus": ("case when l_partkey % 2 = 0 then 'Y' else 'N' end", ()),
    "CollateralInd": ("l_linestatus", ()),
    "FixedorVariableInterestInd": ("case when l_linenumber % 3 = 0 then 'V' when l_linenumber % 3 = 1 then 'F' end", ()),
    "ProcessingMethod": ("o_orderpriority", (O,)),
    "BorrState": ("n_name", (O, C, N)),
    "TermInMonths": (
        "case when l_partkey % 83 = 0 then '0' "
        f"when ({STATUS}) = 'CHGOFF' then cast(30 + l_partkey % 60 as string) "
        "else cast(12 * (1 + l_partkey % 10) as string) end", ()),
    "Program": ("case when l_partkey % 61 = 0 then 'PPP' else ' 7A ' end", ()),
    "ApprovalDate": ("case when l_partkey % 211 = 0 then '' else cast(cast(o_orderdate as date) as string) end", (O,)),
    "ChargeOffDate": (f"case when ({STATUS}) = 'CHGOFF' then cast({RESOLVED_ON} as string) end", ()),
    "PaidInFullDate": (f"case when ({STATUS}) = 'P I F' then cast({RESOLVED_ON} as string) end", ()),
    "AsOfDate": ("case when l_partkey % 7 = 0 then 'n/a' else '2001-12-31' end", ()),
    # raw application file, every field text
    "activity_year": ("cast(cast(year(o_orderdate) as int) as string)", (O,)),
    "action_taken": (
        f"case when l_suppkey % 11 = 0 then '4' when ({IS_DENIED}) = 1 then '3' else '1' end", (O, C)),
    "derived_race": (
        "case c_mktsegment when 'BUILDING' then 'Black or African American' when 'MACHINERY' then 'White' "
        "when 'AUTOMOBILE' then 'Asian' when 'FURNITURE' then 'Joint' else 'Race Not Available' end", (O, C)),
    "derived_ethnicity": (
        "case when o_orderpriority like '1%' then 'Hispanic or Latino' when o_orderpriority like '5%' "
        "then 'Ethnicity Not Available' else 'Not Hispanic or Latino' end", (O,)),
    "derived_sex": ("case when l_linenumber % 3 = 0 then 'Male' when l_linenumber % 3 = 1 then 'Female' else 'Joint' end", ()),
    "applicant_age": (
        "case when l_tax = 0 then '8888' when l_tax < 0.02e0 then '<25' when l_tax < 0.03e0 then '25-34' "
        "when l_tax < 0.04e0 then '35-44' when l_tax < 0.05e0 then '45-54' when l_tax < 0.06e0 then '55-64' "
        "when l_tax < 0.07e0 then '65-74' else '>74' end", ()),
    "loan_amount_text": (
        "case when l_partkey % 101 = 0 then 'NA' when l_partkey % 103 = 0 then '0' "
        "else cast(l_extendedprice * 8.1234567891e0 as string) end", ()),
    "income_text": ("case when c_custkey % 53 = 0 then 'NA' else cast(c_acctbal / 41.234567e0 as string) end", (O, C)),
    "debt_to_income_ratio": (
        "case when l_discount = 0 then 'NA' when l_discount < 0.02e0 then '<20%' when l_discount < 0.03e0 then '20%-<30%' "
        "when l_discount < 0.04e0 then '30%-<36%' when l_discount > 0.095e0 then '>60%' "
        "when l_discount > 0.085e0 then '50%-60%' else cast(30 + cast(round(l_discount * 200e0) as int) as string) end", ()),
    "loan_to_value_ratio": (
        f"case when l_partkey % 10 = 0 and ({IS_DENIED}) = 1 then 'NA' when l_partkey % 37 = 0 then 'Exempt' "
        "else cast(60e0 + l_tax * 400e0 as string) end", (O, C)),
    "property_value": ("case when l_partkey % 41 = 0 then 'Exempt' else cast(l_extendedprice * 10e0 as string) end", ()),
    "tract_to_msa_income_percentage": ("cast(50 + l_suppkey % 100 as string)", ()),
    "tract_owner_occupied_units": ("cast(100 + l_partkey % 900 as string)", ()),
    "ffiec_msa_md_median_family_income": ("cast(40000 + l_suppkey % 50 * 1000 as string)", ()),
    "state_code": ("r_name", (O, C, N, R)),
    "county_text": ("case when n_nationkey % 12 = 5 then 'NA' when n_nationkey % 12 = 7 then '' else n_name end", (O, C, N)),
    "loan_type": ("cast(1 + l_linenumber % 4 as string)", ()),
    "occupancy_type": ("cast(1 + l_linenumber % 2 as string)", ()),
    "construction_method": ("case when l_partkey % 20 = 0 then '2' else '1' end", ()),
    "conforming_loan_limit": ("case when l_extendedprice > 80000 then 'NC' else 'C' end", ()),
    "preapproval": ("cast(1 + l_partkey % 2 as string)", ()),
    "open-end_line_of_credit": ("cast(1 + l_suppkey % 2 as string)", ()),
    "business_or_commercial_purpose": ("cast(1 + l_suppkey % 3 as string)", ()),
    "derived_dwelling_category": ("case when l_partkey % 20 = 0 then 'Manufactured' else 'Site-Built' end", ()),
    "derived_loan_product_type": ("concat('T', cast(1 + l_linenumber % 4 as string))", ()),
    "submission_of_application": ("cast(1 + l_orderkey % 2 as string)", ()),
}

# Columns whose raw name clashes with a typed one above are published under their file name.
RAW_LOAN_FIELDS = (
    "LoanNumber", "LoanStatus", "GrossChargeOffAmount", "ApprovalFY", "GrossApproval",
    "SBAGuaranteedApproval", "InitialInterestRate", "JobsSupported", "NaicsCode",
    "FranchiseCode", "BusinessType", "BusinessAge", "RevolverStatus", "CollateralInd",
    "FixedorVariableInterestInd", "ProcessingMethod", "BorrState", "TermInMonths", "Program",
    "ApprovalDate", "ChargeOffDate", "PaidInFullDate", "AsOfDate",
)
RAW_APPLICATION_FIELDS = (
    "activity_year", "action_taken", "derived_race", "derived_ethnicity", "derived_sex",
    "applicant_age", "loan_amount", "income", "debt_to_income_ratio", "loan_to_value_ratio",
    "property_value", "tract_to_msa_income_percentage", "tract_owner_occupied_units",
    "ffiec_msa_md_median_family_income", "state_code", "county_code", "loan_type",
    "loan_purpose", "lien_status", "occupancy_type", "construction_method",
    "conforming_loan_limit", "preapproval", "open-end_line_of_credit",
    "business_or_commercial_purpose", "derived_dwelling_category",
    "derived_loan_product_type", "submission_of_application",
)
_RAW_NAME = {"loan_amount": "loan_amount_text", "income": "income_text", "county_code": "county_text"}

JOINS = {
    O: "l_orderkey = o_orderkey", C: "o_custkey = c_custkey", N: "c_nationkey = n_nationkey",
    R: "n_regionkey = r_regionkey", P: "l_partkey = p_partkey",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _view(spark: SparkSession, sf_dir: str, wanted: dict[str, str]) -> DataFrame:
    needed = {t for key in wanted.values() for t in COLUMNS[key][1]}
    df = table(spark, sf_dir, "lineitem")
    if O in needed:  # the exchange of the join with orders; a table of one file is no longer read, joined and cast in one task
        df = df.repartition("l_orderkey")
    for name, cond in JOINS.items():
        if name in needed:
            df = df.join(table(spark, sf_dir, name), F.expr(cond))
    return df.select(*[F.expr(COLUMNS[key][0]).alias(out) for out, key in wanted.items()])


def loans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _view(spark, sf_dir, {c: c for c in columns})


def raw_loans(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return _view(spark, sf_dir, {c: c for c in (columns or RAW_LOAN_FIELDS)})


def raw_applications(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    fields = columns or RAW_APPLICATION_FIELDS
    return _view(spark, sf_dir, {c: _RAW_NAME.get(c, c) for c in fields})


def cte(name: str, *columns: str) -> str:
    """A checking-SQL table with the given columns of the view."""
    return _cte(name, {c: c for c in columns})


def _cte(name: str, wanted: dict[str, str]) -> str:
    # `string` is an alias of varchar in the checking engine too
    cols = ",\n  ".join(f'{COLUMNS[key][0]} as "{out}"' for out, key in wanted.items())
    joins = " ".join(f"join {t} on {c}" for t, c in JOINS.items())
    return f"{name} as (select {cols}\n from lineitem {joins})"


LOAN_COLUMNS = [c for c in COLUMNS if c not in RAW_LOAN_FIELDS and c not in RAW_APPLICATION_FIELDS
                 and not c.endswith("_text")] + ["income", "loan_purpose", "lien_status", "county_code"]
LOANS_SQL = _cte("loans", {c: c for c in dict.fromkeys(LOAN_COLUMNS)})
RAW_LOANS_SQL = _cte("raw_loans", {c: c for c in RAW_LOAN_FIELDS})
RAW_APPLICATIONS_SQL = _cte(
    "raw_applications", {c: _RAW_NAME.get(c, c) for c in RAW_APPLICATION_FIELDS}
)
