"""Record types of the listing engine as Spark DDL."""

from __future__ import annotations

LISTING = """seq BIGINT, title STRING, company STRING, portal STRING, location STRING, modality STRING, salary STRING,
url STRING, description STRING, requirements STRING, published_at TIMESTAMP, found_at TIMESTAMP,
raw_posted_text STRING, source_id BIGINT, application_type STRING"""

OFFER = """title STRING, company STRING, portal STRING, location STRING, modality STRING, salary STRING, url STRING,
description STRING, requirements STRING, status STRING, notes STRING, compatibility_score DOUBLE, match_reason ARRAY<STRING>,
published_at TIMESTAMP, found_at TIMESTAMP, raw_posted_text STRING, application_type STRING, normalized_url STRING,
url_hash STRING, source_id BIGINT, notified BOOLEAN, notified_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"""

DISCARDED = """portal STRING, source_id BIGINT, target_role STRING, title STRING, company STRING, location STRING, modality STRING,
salary STRING, url STRING, description STRING, requirements STRING, raw_posted_text STRING, application_type STRING,
compatibility_score DOUBLE, discard_reasons ARRAY<STRING>, detected_keywords ARRAY<STRING>, source_url STRING,
found_at TIMESTAMP, created_at TIMESTAMP, normalized_url STRING, url_hash STRING, seen_count INT, last_seen_at TIMESTAMP"""

SOURCE = """id BIGINT, portal STRING, target_role STRING, search_url STRING, keywords STRING, location STRING, enabled BOOLEAN,
interval_minutes INT, failure_count INT, last_checked_at TIMESTAMP, last_error STRING, paused_until TIMESTAMP,
last_failed_at TIMESTAMP, created_at TIMESTAMP, updated_at TIMESTAMP"""

SEEN_HASH = "url_hash STRING, normalized_url STRING, portal STRING, first_seen_at TIMESTAMP, last_seen_at TIMESTAMP"

NOTIFICATION = "url_hash STRING, channel STRING, status STRING, message STRING, created_at TIMESTAMP"

GENERATED = "url_hash STRING, doc_type STRING, file_path STRING, created_at TIMESTAMP"

CANDIDATE = """full_name STRING, email STRING, phone STRING, city STRING, summary STRING, skills STRING, projects STRING,
education STRING, target_roles STRING, updated_at TIMESTAMP"""

EXPERIENCE = "STRUCT<role STRING, company STRING, location STRING, start_date STRING, end_date STRING, bullets ARRAY<STRING>>"
PROJECT = "STRUCT<name STRING, role STRING, technologies ARRAY<STRING>, bullets ARRAY<STRING>, url STRING>"
PROFILE = f"""full_name STRING, location STRING, phone STRING, email STRING, linkedin STRING, github STRING, portfolio STRING,
professional_summary STRING, technical_skills ARRAY<STRING>, soft_skills ARRAY<STRING>, experiences ARRAY<{EXPERIENCE}>,
projects ARRAY<{PROJECT}>, education ARRAY<STRING>, certifications ARRAY<STRING>, languages ARRAY<STRING>, raw_text STRING"""

PAGE = "requested_url STRING, status_code INT, final_url STRING, content_type STRING, html STRING, block_reason STRING"


def empty(spark, ddl: str):
    """An empty table of a record type."""
    return spark.createDataFrame([], ddl)


def evolved(table, ddl: str):
    """The table with the columns that a newer record type has besides; they are null."""
    return table.unionByName(empty(table.sparkSession, ddl), allowMissingColumns=True)
