"""Schemas of the records that operators take, as DDL."""

OBJECTS = "bucket string, object_key string, length bigint, modified timestamp"
TASK_MESSAGE = "videoKey string, bucket string, taskId string, timestamp bigint, linkName string, submitDate string, customData map<string,string>"
PAGES = "video_key string, link_name string, image_path string, pos bigint, ocr_text string"
PAGE_RULES = "link_name string, page_type string, keywords array<string>, exclude array<string>, min_matches int, verify_regexes array<string>, dedup_strategy string, dedup_rule string, id_pattern string, id_strategy string, params map<string,string>"
RULE_FILE = """link_name string, pages array<struct<page_type:string,
 classify:struct<keywords:array<string>,exclude:array<string>,min_matches:int,verify_regexes:array<string>,threshold:double,case_sensitive:boolean>,
 dedup:struct<strategy_class:string,rule:string,id:struct<mach:array<string>,strategy_class:string>,param:map<string,string>,params:map<string,string>>>>"""
SURVEY_RECORD = "bizId string, createdAt string, data string"
