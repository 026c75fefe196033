"""Explicit schemas of the interchange tables; files are never read with inference."""

from __future__ import annotations

CONTEXT_C = "struct<cid:string,source:string,text:string>"
MESSAGES = "array<struct<role:string,content:string>>"

CHUNK = (
    "chunk_id bigint, content string, title string, parent_title string, file_title string, item_name string"
)
CHUNK_VECTORS = CHUNK + ", dense_vector array<float>, sparse_vector map<int,float>, extra map<string,string>"
ITEM_NAME = "file_title string, item_name string, dense_vector array<float>, sparse_vector map<int,float>"
DOCUMENT = "doc_id bigint, path string, file_title string, md_content string"

SAMPLE = (
    "id string, type string, question string, answer string, "
    f"contexts array<{CONTEXT_C}>, "
    "meta struct<item_name:string,source_chunk_ids:array<bigint>,synthetic:boolean>, split string"
)
MESSAGES_META = (
    "struct<type:string,subtype:string,synthetic:boolean,sources:array<string>,source_chunk_ids:array<bigint>,"
    "battle_capabilities:array<string>,source_schema:string,id:string>"
)
MESSAGES_SAMPLE = f"messages {MESSAGES}, meta {MESSAGES_META}, split string"
SEED = f"messages {MESSAGES}, meta struct<type:string,subtype:string,source:string,battle_capabilities:array<string>>"
GENERATION = "request_id string, question string, answer string"
PREDICTION = "id string, model string, prediction string, faithful int, complete int"

ANSWER = (
    "task_id string, rewritten_query string, query string, answer string, prompt string, is_stream boolean, "
    "contexts array<struct<chunk_id:string,title:string,file_title:string,score:double>>, intent_type string, "
    "provider string, model_name string, error string, latency_ms bigint"
)
TRACE = (
    "ts string, task_id string, provider string, model_name string, is_stream boolean, latency_ms bigint, "
    "query_hash string, answer_hash string, query_chars bigint, answer_chars bigint, prompt_chars bigint, "
    "context_count bigint, intent_type string, used_citations array<string>, is_refusal boolean, "
    "has_answer boolean, error string, query string, answer_preview string, "
    "context_sources array<struct<rank:int,chunk_id:string,title:string,file_title:string,score:double>>"
)
CHAT_MESSAGE = (
    "message_id string, session_id string, role string, text string, rewritten_query string, "
    "item_names array<string>, ts double"
)
TASK_EVENT = "task_id string, node string, phase string, status string, seconds double, ts timestamp"
