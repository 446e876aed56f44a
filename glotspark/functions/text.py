"""Scalar text functions of the localization catalogue, as expressions of built-in functions.

Lengths and cuts count code points; ``utf16_length`` counts as JavaScript does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The words and signs by which texts are told apart.
CJK = "[一-龥]"
JS_SPACE = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"
PUNCTUATION = "，。！？；：、\"'（）【】《》"
TYPE_RULES = [
    ("confirm", "[吗？?]\\z|^(?:确认|是否)"),
    ("error", "不能|禁止|错误|失败|异常"),
    ("success", "成功|完成|已"),
    ("action", "^(?:删除|取消|确定|提交|保存|编辑|新增|修改|查看|下载|上传|导入|导出)"),
    ("input", "^(?:请输入|请选择|请填写)"),
    ("label", "^(?:用户|系统|管理|设置|配置)"),
]
LABEL_LENGTH = 10
AI_KEY = "^[a-z][a-zA-Z0-9]*(?:_[a-zA-Z0-9]+)*\\z"
AI_KEY_LENGTHS = (3, 60)

HASH_LENGTH = 4
MAX_SEMANTIC_LENGTH = 6


def contains_cjk(text: Column, script: str = CJK) -> Column:
    return text.rlike(script)


def utf16_length(text: Column) -> Column:
    return F.length(text) + F.regexp_count(text, F.lit("[\\x{10000}-\\x{10FFFF}]"))


def js_trim(text: Column) -> Column:
    return F.regexp_replace(text, f"^[{JS_SPACE}]+|[{JS_SPACE}]+\\z", "")


def text_type(text: Column) -> Column:
    """The first rule that matches decides."""
    out = None
    for name, pattern in TYPE_RULES:
        hit = text.rlike(pattern)
        if name == "label":
            hit = hit & (utf16_length(text) <= LABEL_LENGTH)
        out = (F.when if out is None else out.when)(hit, F.lit(name))
    return out.otherwise(F.lit("text"))


def semantic(text: Column, n: int = MAX_SEMANTIC_LENGTH) -> Column:
    return F.substring(F.regexp_replace(text, f"[{PUNCTUATION}{JS_SPACE}]", ""), 1, n)


def hash_prefix(text: Column, n: int = HASH_LENGTH) -> Column:
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, n)


def semantic_key(text: Column, hash_length: int = 4, max_semantic: int = 20, type_prefix: bool = True) -> Column:
    """[type.]semantic_hash, without context."""
    body = F.concat(semantic(text, max_semantic), F.lit("_"), hash_prefix(text, hash_length))
    return F.concat(text_type(text), F.lit("."), body) if type_prefix else body


def context_key(text: Column, context: Column, strategy: str = "semantic", hash_length: int = HASH_LENGTH, max_semantic: int = MAX_SEMANTIC_LENGTH, type_prefix: bool = True) -> Column:
    """The catalogue key: context and hash, or context and semantic key."""
    tail = hash_prefix(text, hash_length) if strategy == "hash" else semantic_key(text, hash_length, max_semantic, type_prefix)
    return F.concat(context, F.lit("."), tail)


def sanitize_ai_key(raw: Column) -> Column:
    """A model's key in camel case of ASCII letters and digits; '' where nothing is left."""
    key = F.regexp_replace(js_trim(F.coalesce(raw, F.lit(""))), "[`'\"“”‘’]", "")
    key = F.regexp_replace(F.regexp_replace(key, "\\{\\{|\\}\\}", " "), "[\\[\\]()]", " ")
    key = F.regexp_replace(key, "([a-z])([A-Z])", "$1 $2")
    parts = F.filter(F.split(key, "[^a-zA-Z0-9]+"), lambda x: x != "")
    camel = F.array_join(F.transform(parts, lambda x, i: F.when(i == 0, F.lower(x)).otherwise(F.initcap(x))), "")
    camel = F.regexp_replace(camel, "^[^a-zA-Z]+", "")
    return F.concat(F.lower(F.substring(camel, 1, 1)), F.substring(camel, 2, 1 << 30))


def valid_ai_key(key: Column) -> Column:
    return F.coalesce(key.rlike(AI_KEY) & F.length(key).between(*AI_KEY_LENGTHS), F.lit(False))


def normalized_ai_key(raw: Column) -> Column:
    clean = sanitize_ai_key(raw)
    return F.struct(clean.alias("sanitized"), valid_ai_key(clean).alias("valid"))


def fallback_key(text: Column, hash_length: int = HASH_LENGTH, max_semantic: int = MAX_SEMANTIC_LENGTH) -> Column:
    clean = sanitize_ai_key(semantic_key(text, hash_length, max_semantic, True))
    return F.when(valid_ai_key(clean), clean).otherwise(F.concat(F.lit("auto"), hash_prefix(text, hash_length)))


def jsx_text(text: Column) -> Column:
    """Line breaks and the indent behind them removed."""
    return F.regexp_replace(text, f"\\r?\\n[{JS_SPACE}]*", "")


def reusable(value: Column, is_string: Column | None = None) -> Column:
    """A value that a merge keeps: no null and, for strings, not blank."""
    filled = js_trim(value) != ""
    return F.coalesce(value.isNotNull() & (filled if is_string is None else (~is_string | filled)), F.lit(False))


def needs_translation(value: Column, force: bool = False) -> Column:
    return F.lit(True) if force else value.isNull() | (js_trim(value) == "")


def skipped_call(name: Column, skip: Column) -> Column:
    """No name, or on the list: entries with a dot exactly, others also as a prefix before a dot."""
    hit = F.exists(skip, lambda s: (name == s) | (~F.contains(s, F.lit(".")) & F.startswith(name, F.concat(s, F.lit(".")))))
    return name.isNull() | hit


def cache_key(text: Column, context: Column) -> Column:
    return F.concat_ws("|", text, F.to_json(context))


def without_fence(reply: Column) -> Column:
    body = F.regexp_replace(js_trim(reply), f"(?i)^```(?:json)?[{JS_SPACE}]*\\n?", "")
    return F.regexp_replace(body, f"(?i)\\n?```[{JS_SPACE}]*\\z", "")


def simple_text(detail: Column, plain: Column) -> Column:
    """A catalogue value's text: the string itself, or a detail's text or ''."""
    return F.coalesce(plain, detail["text"], F.lit(""))


def language_list(option: Column) -> Column:
    return F.filter(F.transform(F.split(option, ","), js_trim), lambda x: x != "")


def batch_item(text: Column, file_path: Column, file_type: Column, given_type: Column) -> Column:
    """A key request with its context filled: the text's own type where none is given."""
    return F.struct(text.alias("text"), F.struct(file_path.alias("filePath"), file_type.alias("fileType"), F.coalesce(given_type, text_type(text)).alias("textType")).alias("context"))


def first_replaced(code: Column) -> Column:
    return F.regexp_replace(code, "^([^_]*)_", "$1-")


def to_locale(code: Column) -> Column:
    return F.when(code.isNull() | (code == ""), F.lit("zh-CN")).otherwise(js_trim(first_replaced(code)))


def normalize_locale(code: Column) -> Column:
    return F.when(F.contains(code, F.lit("-")), code).otherwise(first_replaced(code))


def default_locale_code(code: Column) -> Column:
    return first_replaced(to_locale(code))
