"""Explicit schemas of the domain tables; nothing is inferred."""

from __future__ import annotations

from pyspark.sql.types import StructType

_DDL = {
    "user": "id string, email string, created_at timestamp",
    "otp_code": "id string, email string, code_hash string, expires_at timestamp, attempts int, consumed_at timestamp, created_at timestamp",
    "file": "id string, user_id string, name string, mime_type string, size_bytes int, object_key string, status string, error string, source string, created_at timestamp, indexed_at timestamp",
    "space": "id string, user_id string, name string, description string, description_embedding array<double>, version int, reclassifying boolean, created_at timestamp, updated_at timestamp",
    "connection": "id string, user_id string, label string, token_hash string, last_seen timestamp, revoked_at timestamp, created_at timestamp",
    "grant": "connection_id string, space_id string, created_at timestamp",
    "memory_index": "memory_id string, user_id string, file_id string, space_ids array<string>, space_versions map<string,int>, manual_override boolean, source string, created_at timestamp",
    "growth_event": "id string, user_id string, space_id string, memory_id string, created_at timestamp",
    "access_log": "id string, connection_id string, action string, space_ids array<string>, query_hash string, result_count int, created_at timestamp",
    "point": "id string, user_id string, file_id string, source string, space_ids array<string>, text string, vector array<float>",
    "ingest_job": "file_id string, user_id string, source string",
    "backfill_job": "space_id string, user_id string, new_version int",
    "chat_export": "c array<struct<title:string, mapping:map<string, struct<message:struct<author:struct<role:string>, content:struct<content_type:string, parts:array<string>>>, children:array<string>>>>>",
    "graph": "nodes array<struct<id:string,name:string,type:string>>, links array<struct<source:string,target:string,label:string>>",
    "lead": "created_at string, email string, role string, experience string, ai_tools string, monthly_spend string, source string, referer string, user_agent string, language string, utm_source string, utm_medium string, utm_campaign string",
    "stream_event": "type string, delta string, name string, tool_calls array<string>",
    "persona": "id string, name string, role string, company string, memories array<string>",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(_DDL[name])


#: Fixed values of the domain.
FILE_STATUS = ("pending", "processing", "indexed", "failed")
MIME_TEXT = ("text/plain", "text/markdown", "text/csv", "application/json")
MIME_PDF, MIME_DOCX = "application/pdf", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
MAX_FILE_BYTES = 20 * 1024 * 1024
EXPERIENCE = ("junior", "mid", "senior", "clevel")
MONTHLY_SPEND = ("0", "1-20", "21-100", "100+")
