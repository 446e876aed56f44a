"""Localization catalogues and training corpora on Spark DataFrames."""

from glotspark.config import Config, create_config, define_config, get_config, load_config, reset_config, set_active_config
from glotspark.config import find_config as resolve_config_path
from glotspark.functions.paths import context_info, key_context
from glotspark.functions.text import context_key as generate_key
from glotspark.functions.text import fallback_key, semantic, text_type
from glotspark.operators.aikeys import generate as generate_ai_keys
from glotspark.operators.catalog import collisions as detect_collisions
from glotspark.operators.catalog import with_keys as generate_keys
from glotspark.operators.report import key_report
from glotspark.plans.application import Extracted, extract, generate_keys_batch, write_sources
from glotspark.plans.application import translate_missing as translate

__all__ = [
    "Config", "Extracted", "context_info", "create_config", "define_config", "detect_collisions", "extract", "fallback_key", "generate_ai_keys", "generate_key", "generate_keys",
    "generate_keys_batch", "get_config", "key_context", "key_report", "load_config", "reset_config", "resolve_config_path", "semantic", "set_active_config", "text_type", "translate", "write_sources",
]
