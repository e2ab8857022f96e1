"""Sources and sinks (survey 2.1). Files are written from the test tables to the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loanlens.config import TESTBED as CFG
from loanlens.functions import scalar as S
from loanlens.operators import drift
from loanlens.plans.drift import NUM, POP_SQL, numeric_profile, population
from loanlens.plans.registry import n, query, r, rounded
from loanlens.session import scratch_path
from loanlens.sources import files
from loanlens.sources.testbed import (
    LOANS_SQL, RAW_APPLICATIONS_SQL, RAW_LOANS_SQL, loans, raw_applications, raw_loans,
)

CSV_FIELDS = ("LoanNumber", "LoanStatus", "GrossApproval", "ApprovalFY", "FranchiseCode", "Program")


@query("scan_csv_union", f"""with {RAW_LOANS_SQL} select trim("LoanStatus") status, count(*) n, round(sum(try_cast("GrossApproval" as double)), 2) amount,
 count(*) filter (trim("Program") = 'PPP') ppp, count(*) filter (coalesce(trim("FranchiseCode"), '') <> '' and trim("LoanStatus") in ('CANCLD', 'EXEMPT')) franchise
 from raw_loans group by 1""")
def scan_csv_union(spark, d):
    """Two header layouts: columns in another order, and one column absent in the second."""
    raw = raw_loans(spark, d, *CSV_FIELDS)
    base, open_ = scratch_path(spark, "csv"), F.trim("LoanStatus").isin("CANCLD", "EXEMPT")
    options = {"header": True, "encoding": "ISO-8859-1"}
    raw.where(open_).write.options(**options).csv(f"{base}/a")
    raw.where(~open_).select(*[c for c in reversed(CSV_FIELDS) if c != "FranchiseCode"]).write.options(**options).csv(f"{base}/b")
    both = files.read_csv_union(spark, [f"{base}/a", f"{base}/b"])
    return both.groupBy(F.trim("LoanStatus").alias("status")).agg(
        n().alias("n"), r(F.sum(S.to_double("GrossApproval")), 2).alias("amount"),
        F.count_if(F.trim("Program") == "PPP").alias("ppp"), n(S.presence_flag("FranchiseCode")).alias("franchise"))


KEEP = ("activity_year", "state_code", "action_taken", "derived_race", "loan_amount", "income", "not_in_this_file")


def ingested(spark, d):
    path = scratch_path(spark, "applications")
    raw = raw_applications(spark, d, "activity_year", "state_code", "action_taken", "derived_race", "derived_sex", "loan_amount", "income")
    files.ingest(raw.withColumn("activity_year", F.col("activity_year").cast("int")), path, KEEP, ["activity_year"])
    return path


@query("scan_parquet_years", f"""with {RAW_APPLICATIONS_SQL} select cast(activity_year as integer) activity_year, count(*) n from raw_applications
 where action_taken in ('1', '3') and cast(activity_year as integer) between 1996 and 2000 group by 1""")
def scan_parquet_years(spark, d):
    df = files.read_years(spark, ingested(spark, d), CFG.application_years)
    return df.groupBy("activity_year").agg(n().alias("n"))


@query("ingest_prune_filter", f"""with {RAW_APPLICATIONS_SQL} select action_taken, derived_race, count(*) n, round(sum(try_cast(loan_amount as double)), 2) amount
 from raw_applications where action_taken in ('1', '3') group by 1, 2""")
def ingest_prune_filter(spark, d):
    df = spark.read.parquet(ingested(spark, d))
    return df.groupBy("action_taken", "derived_race").agg(n().alias("n"), r(F.sum(S.to_double("loan_amount")), 2).alias("amount"))


@query("file_metadata", f"""with {LOANS_SQL} select '260630' vintage, cast(case when approval_fy < 1999 then 1995 else 1999 end as integer) fy_first,
 case when approval_fy < 1999 then 1998 end fy_last, count(*) n from loans group by all""")
def file_metadata(spark, d):
    """Each loan's fiscal year names the file it would be in; the name gives vintage and span back."""
    name = F.when(F.col("approval_fy") < 1999, "data/FOIA_7a_FY1995_FY1998_asof_260630.csv").otherwise(
        "data/FOIA_7a_FY1999_Present_asof_260630.csv")
    df = files.with_name_metadata(loans(spark, d, "approval_fy").withColumn("path", name), "path")
    return df.groupBy("vintage", "fy_first", "fy_last").agg(n().alias("n"))


@query("vintage_as_of", f"""with {RAW_LOANS_SQL} select max(try_cast("AsOfDate" as date)) as_of from raw_loans""")
def vintage_as_of(spark, d):
    return files.vintage_as_of(raw_loans(spark, d, "AsOfDate"))


@query("manifest_verify")
def manifest_verify(spark, d):
    """The test tables' own files against a manifest with one altered and one missing entry."""
    digests = files.file_digests(spark, f"{d}/*.parquet")
    name = F.col("name")
    manifest = digests.select(
        F.when(name == "region.parquet", "absent.parquet").otherwise(name).alias("name"),
        F.when(name == "nation.parquet", F.lit("0" * 64)).otherwise(F.col("sha256")).alias("sha256"))
    return files.verify_manifest(manifest, digests)


MANIFEST_SQL = f"""{RAW_APPLICATIONS_SQL}, o as (select activity_year as year, state_code state, count(*) n from raw_applications where activity_year <= '1999' group by all),
 w as (select activity_year as year, state_code state, count(*) n from raw_applications where activity_year >= '1999' and action_taken <> '4' group by all)"""


def manifests(spark, d):
    raw = raw_applications(spark, d, "activity_year", "state_code", "action_taken").withColumnsRenamed({"activity_year": "year", "state_code": "state"})
    count = lambda df: df.groupBy("year", "state").agg(n().alias("n"))
    return count(raw.where(F.col("year") <= "1999")), count(raw.where((F.col("year") >= "1999") & (F.col("action_taken") != "4")))


@query("manifest_merge", f"""with {MANIFEST_SQL} select year, state, n from w union all select year, state, n from o
 where not exists (select 1 from w where w.year = o.year and w.state = o.state)""")
def manifest_merge(spark, d):
    return files.merge_manifest(*manifests(spark, d), ["year", "state"])


@query("completeness_reconcile", f"""with {MANIFEST_SQL} select coalesce(o.year, w.year) as year, coalesce(o.state, w.state) state, o.n local_rows, w.n official_rows,
 o.n is not distinct from w.n matches from o full join w on o.year = w.year and o.state = w.state""")
def completeness_reconcile(spark, d):
    local, official = (t.withColumnRenamed("n", "rows") for t in manifests(spark, d))
    return files.reconcile_counts(local, official, ["year", "state"])


@query("snapshot_predictions", f"""with {LOANS_SQL} select cast(is_bad as integer) y, count(*) n, round(avg(cast(cast(score_a as real) as double)), 6) score_a,
 round(avg(cast(cast(score_b as real) as double)), 6) score_b from loans group by 1""")
def snapshot_predictions(spark, d):
    path = scratch_path(spark, "predictions")
    files.save_predictions(loans(spark, d, "is_bad", "score_a", "score_b"), path, "is_bad", ["score_a", "score_b"])
    back = spark.read.parquet(path)
    return back.groupBy(F.col("y").cast("int").alias("y")).agg(
        n().alias("n"), *[r(F.avg(F.col(m).cast("double"))).alias(m) for m in ("score_a", "score_b")])


EXPORT_SQL = "select region, count(*) n, round(avg(score_a), 6) mean_score, cast(null as double) ratio from loans group by 1"


@query("export_results", f"with {LOANS_SQL} select 'csv' format, * from ({EXPORT_SQL}) union all select 'json', * from ({EXPORT_SQL})")
def export_results(spark, d):
    """One summary as CSV and as JSON; its NaN column must come back as null."""
    table = loans(spark, d, "region", "score_a").groupBy("region").agg(
        n().alias("n"), r(F.avg("score_a")).alias("mean_score")).withColumn("ratio", F.lit(float("nan")))
    base = scratch_path(spark, "export")
    files.export_csv(files.finite_only(table), f"{base}/csv", ["region"])
    files.export_json(table, f"{base}/json", ["region"])
    schema = "region string, n bigint, mean_score double, ratio double"
    csv = spark.read.schema(schema).csv(f"{base}/csv", header=True)
    return csv.select(F.lit("csv").alias("format"), "*").unionByName(
        spark.read.schema(schema).json(f"{base}/json").select(F.lit("json").alias("format"), "*"))


@query("profile_roundtrip", f"with {POP_SQL} select feature, count(*) bins, true identical from prof where feature <> 'score' group by feature")
def profile_roundtrip(spark, d):
    """A stored profile and its copy read back, with the largest difference of their bounds."""
    path = scratch_path(spark, "profile")
    long = drift.profile_long(numeric_profile(population(spark, d)))
    files.save_profile(long, path)
    back = files.load_profile(spark, path).withColumnsRenamed({"lo": "lo2", "hi": "hi2", "share": "share2"})
    both = long.join(back, ["feature", "bin"], "full_outer")
    same = F.col("lo").eqNullSafe(F.col("lo2")) & F.col("hi").eqNullSafe(F.col("hi2")) & F.col("share").eqNullSafe(F.col("share2"))
    return both.groupBy("feature").agg(n().alias("bins"), F.bool_and(same).alias("identical"))


__all__ = ["NUM", "rounded"]
