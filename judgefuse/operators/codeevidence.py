"""Code-review evidence parsing and file handling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Response tag pattern and the record layout the review prompt asks for.
RESPONSE_RE = r"(?s)<RESPONSE>(.*?)</RESPONSE>"
CASE_SCHEMA = ("array<struct<test_case: string, related_requirement: string, requirement_id: string, "
               "code_review: struct<is_implemented: boolean, evidence: string>, files: array<string>>>")


def parse_responses(df: DataFrame, text: str = "text", key: str = "project_name") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected).  The tagged block is stripped and parsed as a
    JSON array of test cases, one output row per case with its position;
    responses without the tag or with invalid JSON go to ``rejected`` with a
    reason instead of failing the job."""
    body = F.when(F.col(text).rlike(RESPONSE_RE), F.trim(F.regexp_extract(F.col(text), RESPONSE_RE, 1)))
    p = df.select(key, body.alias("_body"))
    p = p.withColumn("_cases", F.from_json("_body", CASE_SCHEMA))
    rejected = p.filter(F.col("_cases").isNull()).select(
        key, F.when(F.col("_body").isNull(), F.lit("no RESPONSE block")).otherwise(F.lit("invalid JSON")).alias("reason"))
    # NULL (rejected) and empty arrays give no accepted rows; the outer
    # generator with a position filter parses the JSON once
    acc = p.select(key, F.posexplode_outer("_cases").alias("case_idx", "c")).filter(F.col("case_idx").isNotNull()).select(
        key, "case_idx", F.col("c.test_case").alias("test_case"), F.col("c.requirement_id").alias("requirement_id"),
        F.col("c.code_review.is_implemented").alias("is_implemented"), F.col("c.code_review.evidence").alias("evidence"),
        F.col("c.files").alias("files"))
    return acc, rejected


def ordered_distinct_files(cases: DataFrame, key: str = "project_name") -> DataFrame:
    """Files of all cases of a project, first occurrence kept, in order:
    (key, file, first_pos) with first_pos = (case_idx, file_idx) rank order."""
    f = cases.select(key, "case_idx", F.posexplode_outer("files").alias("file_idx", "file")) \
        .filter(F.col("file_idx").isNotNull())
    return f.groupBy(key, "file").agg(F.min(F.struct("case_idx", "file_idx")).alias("_first")) \
        .select(key, "file", F.col("_first.case_idx").alias("case_idx"), F.col("_first.file_idx").alias("file_idx"))


def manifest_filter(manifest: DataFrame, path: str = "path") -> DataFrame:
    """Relative paths not starting with '.', sorted."""
    return manifest.filter(~F.col(path).startswith(".")).orderBy(path)


def code_lookup(wanted: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """Requested paths -> contents; paths without a readable file are skipped."""
    return wanted.join(files, path, "inner")
