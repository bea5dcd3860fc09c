"""Relations of the engine as DDL; nested lists stay exploded between operators."""

from __future__ import annotations

WORDS = "file string, page int, seq int, text string, x0 double, x1 double, top double, bottom double"
RECTS = "file string, page int, seq int, x0 double, x1 double, top double, bottom double, width double, fill boolean"
PAGES = "file string, page int, width double, height double"
SLOTS = "array<struct<x_start:double,x_end:double,label:string,idx:int>>"
BANDS = "array<struct<y_top:double,y_bottom:double,day:string,seq:int>>"
ENTRY = "day string, start_time string, end_time string, type string, weeks string, week_count int, course string, staff string, room string, group_label string, raw_text string"
RESULT = f"source_file string, semester string, course_title string, entries array<struct<{ENTRY.replace(' ', ':').replace(',:', ',')}>>"
RESOURCE = "id string, type string, link string, name string, dept string, faculty string"
HEADERS = "file string, page int, label string, x0 double, x1 double, top double, bottom double"
SCAN_ERRORS = "file string, error string"
NORMALISED = "day string, start_time string, end_time string, start_minutes int, end_minutes int, duration_minutes int, room string, staff string, activity_type string, course string, weeks string, week_count int, group_label string"
REGIONS = "struct<header_top:double,header_bottom:double,table_top:double,table_bottom:double,footer_bottom:double>"
COLUMN = "struct<left:double,right:double>"
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
CONFIG = f"struct<page_regions:{REGIONS},day_columns:struct<{','.join(f'{d}:{COLUMN}' for d in DAYS)}>,time_slot_map:array<struct<label:string,top:double,bottom:double>>,text_patterns:struct<module_code_regex:string,room_pattern:string,staff_pattern:string,activity_types:array<string>>,confidence:double,layout_signature:string>"
CONFIG_DOCUMENT = f"config_id string, course_id string, course_code string, version int, status string, generated_by string, llm_session_id string, config {CONFIG}, rejection_reason string, created_at timestamp"
SESSION_EVENT = "session_id string, seq long, course_code string, status string, phase string, phase_state string, config_id string, confidence double, report string, anomalies array<string>, at timestamp"
LLM_EXTRACTION = "struct<course_code:string,course_name:string,semester:string,entries:array<struct<day:string,start_time:string,end_time:string,room:string,activity_type:string,staff:string>>,layout_notes:string,confidence:double>"
STREAM = "course_id string, stream_id string, type string, type_key string, day string, start_time string, end_time string, room string, staff string, group_label string, weeks string, week_count int"
PLACEMENT = "course_id string, stream_type string, selected_stream_id string"
