"""Guards on what comes in, and the job records: URLs, file types, ids, latest state, expiry, retries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Statuses that a caller may be told; those of failures that need evidence; those of a report that are error codes; fetchable types.
TOOL_STATUSES = (
    "PROCESSING", "PASS", "EDITABILITY_FAILED", "FIDELITY_FAILED", "VALIDATION_INCOMPLETE", "PACKAGE_INVALID", "GENERATION_FAILED",
    "UNSUPPORTED_NATIVE_RECONSTRUCTION", "RASTER_FALLBACK_PROHIBITED",
)
EVIDENCE_STATUSES = TOOL_STATUSES[2:]
REPORT_CODES = ("EDITABILITY_FAILED", "FIDELITY_FAILED", "VALIDATION_INCOMPLETE")
MIME_TYPES = ("image/png", "image/jpeg", "image/webp", "application/pdf")
UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$"


def url_code(url) -> F.Column:
    """Why an address may not be fetched, or OK: only public https hosts may."""
    url = F.coalesce(url, F.lit(""))
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/:?#]*)", 1))
    octet = lambda i: F.try_element_at(F.split(host, r"\."), F.lit(i)).cast("int")
    ipv4 = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    a, b = F.when(ipv4, octet(1)), F.when(ipv4, octet(2))
    private = a.isin(0, 10, 127) | ((a == 169) & (b == 254)) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | (a >= 224)
    local = host.isin("localhost", "::1", "[::1]") | host.rlike(r"\.(localhost|local)$|^\[f[cd]|^\[fe80:")
    invalid = (scheme == "") | (scheme.isin("http", "https") & (host == "")) | (ipv4 & F.exists(F.split(host, r"\."), lambda x: F.length(x) > 3)) | (ipv4 & F.exists(F.split(host, r"\."), lambda x: x.cast("int") > 255))
    case = F.when(invalid, "REF_URL_INVALID").when(scheme != "https", "REF_HTTPS_REQUIRED")
    return case.when(local | F.coalesce(private, F.lit(False)), "REF_PRIVATE_ADDRESS").otherwise("OK")


def mime(content) -> F.Column:
    """File type by its first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    return F.when(head.startswith("89504E470D0A1A0A"), "image/png").when(head.startswith("FFD8FF"), "image/jpeg").when(head.rlike("^52494646.{8}57454250"), "image/webp").when(head.startswith("255044462D"), "application/pdf").otherwise("unsupported")


def content_code(content, declared, answered) -> F.Column:
    """Why fetched bytes may not be used, or OK: their type must be known and agree with what was declared and answered.

    An answered type counts only where it is one that may be fetched.
    """
    found = mime(content)
    clean = lambda c: F.lower(F.trim(F.split_part(F.coalesce(c, F.lit("")), F.lit(";"), F.lit(1))))
    clash = ((clean(declared) != "") & (clean(declared) != found)) | (clean(answered).isin(*MIME_TYPES) & (clean(answered) != found))
    return F.when(~found.isin(*MIME_TYPES), "REF_TYPE_UNSUPPORTED").when(clash, "REF_MIME_MISMATCH").otherwise("OK")


def narrowed_scopes(requested, supported) -> F.Column:
    """The distinct requested scopes that are supported, in the order of the request; null where none is."""
    kept = F.array_distinct(F.filter(F.coalesce(requested, F.array().cast("array<string>")), lambda s: F.array_contains(supported, s)))
    return F.when(F.size(kept) > 0, kept)


def principal_code(principal, scopes, resource, origin, needed: str) -> F.Column:
    """Why a caller may not act, or OK: it has an id, the needed scope, and was admitted for this very origin."""
    scoped = F.coalesce(F.array_contains(scopes, F.lit(needed)), F.lit(False))
    return F.when(F.coalesce(principal, F.lit("")) == "", "auth_required").when(~scoped, "forbidden_scope").when(~resource.eqNullSafe(origin), "resource_audience_mismatch").otherwise("OK")


def numeric_ids(text) -> F.Column:
    """The distinct positive whole numbers of a comma-separated list, as they are written."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda s: F.trim(s))
    return F.array_distinct(F.filter(parts, lambda s: s.rlike("^[1-9][0-9]*$")))


def is_job_id(c) -> F.Column:
    return F.coalesce(c.rlike(UUID), F.lit(False))


def job_id_of(task_id, instructions, expected) -> F.Column:
    """The id given with the task, else after JOB_ID: in the instructions, else that of the expectations."""
    said = F.nullif(F.regexp_extract(F.coalesce(instructions, F.lit("")), r"JOB_ID:([0-9a-fA-F-]{36})", 1), F.lit(""))
    return F.coalesce(task_id, said, expected)


def latest(jobs: DataFrame, *, key: str = "job_id") -> DataFrame:
    """The last record of each job by time, then by number."""
    w = Window.partitionBy(key).orderBy(F.col("ts").desc(), F.col("event_id").desc())
    return jobs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def with_expiry(jobs: DataFrame, now, hours: int = 24) -> DataFrame:
    """Records with whether they are expired at ``now``: from the full lifetime on, inclusive."""
    return jobs.withColumn("expired", F.lit(now).cast("timestamp") >= F.col("ts") + F.make_dt_interval(hours=F.lit(hours)))


def response(jobs: DataFrame) -> DataFrame:
    """What a caller is told: absent, a failure's own code where it is known, PROCESSING or PASS."""
    case = F.when(F.col("status").isNull(), "NOT_FOUND").when(F.col("status") == "FAILED", F.when(F.col("error_code").isin(*TOOL_STATUSES), F.col("error_code")).otherwise("VALIDATION_INCOMPLETE")).otherwise(F.col("status"))
    return jobs.withColumn("response", case)


def failure_status(code, report_status, has_report) -> F.Column:
    """What a failed job is recorded as: the report's status, else the code, if there is evidence and it is a known one."""
    known = lambda c: has_report & F.coalesce(c.isin(*EVIDENCE_STATUSES), F.lit(False))
    return F.when(known(report_status), report_status).when(known(code), code).otherwise("VALIDATION_INCOMPLETE")


def error_code(report_status) -> F.Column:
    """The error code that a report's status stands for."""
    return F.when(report_status.isin(*REPORT_CODES), report_status).otherwise("FIDELITY_FAILED")


def with_workflow(jobs: DataFrame, workflows: DataFrame, *, key: str = "job_id") -> DataFrame:
    """Jobs with the status of their workflow, ``unknown`` without one, and its error with addresses and tokens replaced."""
    w = workflows.select(key, F.col("status").alias("_status"), F.col("error_name").alias("_name"), F.col("error_message").alias("_message"))
    failed = F.col("_name").isNotNull() | F.col("_message").isNotNull()
    said = F.regexp_replace(F.regexp_replace(F.coalesce("_message", F.lit("unknown workflow error")), r"(?i)https?://\S+", "[url]"), r"[A-Za-z0-9_-]{32,}", "[redacted]")
    error = F.when(failed, F.struct(F.left(F.coalesce("_name", F.lit("Error")), F.lit(80)).alias("name"), F.left(said, F.lit(240)).alias("message")))
    out = jobs.join(w, key, "left").withColumns({"workflow_status": F.coalesce("_status", F.lit("unknown")), "workflow_error": error})
    return out.drop("_status", "_name", "_message")


def retry_schedule(budgets: DataFrame, *, key: str = "job_id", attempts: int = 5, base: float = 5.0) -> DataFrame:
    """(key, attempt, delay): doubling delays while the job's budget lasts."""
    steps = budgets.select(key, "budget", F.explode(F.sequence(F.lit(0), F.lit(attempts - 2))).alias("attempt"))
    spent = F.lit(base) * (F.pow(F.lit(2.0), F.col("attempt")) - 1)
    delay = F.least(F.lit(base) * F.pow(F.lit(2.0), F.col("attempt")), F.col("budget") - spent)
    return steps.select(key, "attempt", delay.alias("delay")).where("delay > 0")
