"""Schemas of the canonical tables, as DDL."""

PROVENANCE = "source string, source_name string, source_role string, origin string, type string, schema_version string, source_title string"
TRIPLE = f"subject string, relation string, object string, pattern string, raw string, {PROVENANCE}, source_url string, source_field string, property_id string, table_field string, source_record_id string, license_hint string, fetched_at string, raw_value string, normalized_value string, unit string, confidence double"
NARRATIVE = f"page_title string, section string, path string, chunk_index int, content string, keywords array<string>, chunk_id string, {PROVENANCE}"
EDGE = "subject string, relation string, object string, source_name string, ordinal bigint"
BUNDLE = "version string, source_name string, note string, records array<struct<title:string,triples:array<struct<subject:string,relation:string,object:string,pattern:string,raw:string>>,narratives:array<struct<page_title:string,section:string,content:string,keywords:array<string>>>>>"
CLAIMS = "entities map<string,struct<labels:map<string,struct<value:string>>,claims:map<string,array<struct<id:string,mainsnak:struct<datavalue:struct<value:string>>>>>>>, fetched_at string"
