"""Schemas of the tables that the localization operators exchange."""

OCCURRENCES = "file string, ord long, text string, kind string, start int, end int, line int, vars array<string>"
CATALOG = "key string, text string, context string, interpolations array<string>, ord long"
LOCALE_ENTRIES = "locale string, key string, value string, ord long"
TOP_LEVEL = "file string, name string, line int, column int, intl_key string"
FILE_STATS = "file string, extracted long, data_constants long, skipped long, error string"
RESPONSES = "lang string, batch_id long, key string, value string"
QUARANTINE = "lang string, batch_id long, key string, text string, reason string, raw_response string"
AI_CACHE = "cache_key string, key string, ts timestamp"
PLACEHOLDERS = "array<struct<name:string,cnt:long>>"
