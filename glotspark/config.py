"""Configuration: defaults, merging, loading, validation."""

from __future__ import annotations

import importlib.util
import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any


class _Undefined:
    """Stands for a setting that is not given, where None would be a value."""

    def __repr__(self) -> str:
        return "UNDEFINED"


UNDEFINED = _Undefined()

# Defaults.
DEFAULT_SOURCE = "zh_CN"
LANGUAGES = {"zh_CN": {"name": "简体中文", "code": "zh-CN"}, "en_US": {"name": "English", "code": "en-US"}}
DEFAULTS: dict[str, Any] = {
    "project_root": None,
    "ai_provider": {"api_key": "", "api_url": "https://api.openai.com/v1/chat/completions", "model": "gpt-4o-mini", "temperature": 0.3, "max_tokens": 2000, "requests_per_minute": 20, "max_retries": 3, "headers": {}, "body": {}},
    "languages": {"source": DEFAULT_SOURCE, "targets": list(LANGUAGES), "map": LANGUAGES},
    "translation": {"batch_size": 10, "max_tokens_per_request": 1000, "batch_delay": 300, "parallel_requests": 1},
    "key_generation": {"strategy": "semantic", "hash_length": 4, "max_semantic_length": 6, "use_type_prefix": True, "ai": {"enabled": False, "batch_size": 10, "fallback_to_semantic": True, "cache": {"file_path": ".cache/i18n-ai-cache", "ttl": 30, "enabled": True}}},
    "input": ["src/**/*.{ts,tsx,js,jsx}"],
    "ignore": ["**/node_modules/**", "**/locales/**", "**/*.d.ts", "**/*.test.{ts,tsx,js,jsx}", "**/*.spec.{ts,tsx,js,jsx}", "**/dist/**"],
    "skip_function_calls": ["console", "require", "import"],
    "locales_dir": "locales",
    "namespace": "translation",
    "reporting": {"top_level_warnings_path": "docs/i18n-top-level-warnings.md"},
    "post_commands": [],
}
CONFIG_NAMES = ["i18n.config.py", "i18n.config.yaml", "i18n.config.yml", "i18n.config.json"]


def deep_merge(base: Any, over: Any) -> Any:
    """Objects key by key, all else replaced; UNDEFINED keeps the base, None replaces it. Inputs stay as they are."""
    if over is UNDEFINED:
        return deep_merge({}, base) if isinstance(base, dict) else base
    if not isinstance(over, dict):
        return list(over) if isinstance(over, list) else over
    out = {k: deep_merge({}, v) if isinstance(v, dict) else v for k, v in base.items()} if isinstance(base, dict) else {}
    for k, v in over.items():
        if v is not UNDEFINED:
            out[k] = deep_merge(out.get(k), v)
    return out


def locale_of(code: str | None) -> str:
    if not code or not isinstance(code, str):
        return "zh-CN"
    return code.replace("_", "-", 1).strip()


def normalize_targets(source: str, targets: list[str] | None) -> list[str]:
    """Source first, then the targets in order, without blanks and repeats; defaults where none is left."""
    named = [t.strip() for t in targets or [] if isinstance(t, str) and t.strip()]
    return list(dict.fromkeys([source, *(named or list(LANGUAGES))]))


@dataclass
class Config:
    settings: dict[str, Any] = field(default_factory=dict)
    root: Path = field(default_factory=Path.cwd)
    normalize_locale_code: Callable[[str], str] = lambda code: locale_of(code).replace("_", "-", 1)

    def __getitem__(self, name: str) -> Any:
        return self.settings[name]

    def language_name(self, code: str) -> str:
        return self.settings["languages"]["map"].get(code, {}).get("name", code)

    def output_path(self, locale: str, kind: str = "", absolute: bool = True) -> Path:
        """<locales_dir>/<normalised locale>/<namespace>[.detail|.report].json"""
        suffix = f".{kind}.json" if kind else ".json"
        path = Path(self["locales_dir"]) / self.normalize_locale_code(locale) / (self["namespace"] + suffix)
        return self.root / path if absolute else path


def create_config(user: dict[str, Any] | None = None, root: str | Path | None = None, normalize_locale_code: Callable[[str], str] | None = None) -> Config:
    settings = deep_merge(DEFAULTS, user or {})
    languages = settings["languages"]
    languages["targets"] = normalize_targets(languages["source"], languages["targets"])
    config = Config(settings, Path(root or settings.get("project_root") or Path.cwd()).absolute())
    if normalize_locale_code:
        config.normalize_locale_code = normalize_locale_code
    validate(config)
    return config


def validate(config: Config) -> None:
    """Raises ValueError for the first setting that is out of range."""
    languages, keys = config["languages"], config["key_generation"]
    if not languages.get("source") or not isinstance(languages.get("targets"), list):
        raise ValueError("languages: source and targets are needed")
    if languages["source"] not in languages["targets"]:
        raise ValueError(f"languages: the source {languages['source']} must be among the targets")
    if bad := [c for c in languages["targets"] if not re.fullmatch(r"[a-z]{2}[_-][A-Z]{2}", c)]:
        raise ValueError(f"languages: {', '.join(bad)} not of the form zh_CN or zh-CN")
    if not 4 <= keys["hash_length"] <= 8:
        raise ValueError("key_generation: hash_length must be 4 to 8")
    if not 4 <= keys["max_semantic_length"] <= 12:
        raise ValueError("key_generation: max_semantic_length must be 4 to 12")
    if keys["strategy"] not in ("semantic", "hash", "ai"):
        raise ValueError("key_generation: strategy must be semantic, hash or ai")
    if keys["strategy"] == "ai" and keys["ai"]["enabled"]:
        if not 1 <= keys["ai"]["batch_size"] <= 50:
            raise ValueError("key_generation: ai.batch_size must be 1 to 50")
        if not config["ai_provider"]["api_key"]:
            raise ValueError("key_generation: the ai strategy needs ai_provider.api_key")
    if not isinstance(config["input"], list) or not config["input"]:
        raise ValueError("input: at least one pattern is needed")
    if not config.output_path(languages["source"]).is_absolute():
        raise ValueError("output paths must be absolute")


def find_config(folder: str | Path, explicit: str | None = None) -> Path | None:
    if explicit:
        path = Path(folder, explicit)
        if not path.exists():
            raise FileNotFoundError(path)
        return path
    return next((p for n in CONFIG_NAMES if (p := Path(folder, n)).exists()), None)


def read_config(path: Path, command: str = "extract", mode: str = "default") -> dict[str, Any]:
    """JSON, YAML (where a YAML library is installed) or a Python module with `config` or `default`,
    which may be a function of {command, mode}."""
    if path.suffix == ".json":
        return json.loads(path.read_text("utf-8"))
    if path.suffix in (".yaml", ".yml"):
        try:
            import yaml
        except ImportError as e:
            raise RuntimeError("reading a YAML configuration needs the yaml package") from e
        return yaml.safe_load(path.read_text("utf-8")) or {}
    if path.suffix == ".py":
        spec = importlib.util.spec_from_file_location("glotspark_user_config", path)
        module = importlib.util.module_from_spec(spec)
        spec.loader.exec_module(module)
        found = getattr(module, "default", None) or getattr(module, "config", None)
        return found({"command": command, "mode": mode}) if callable(found) else found or {}
    raise ValueError(f"{path.suffix} is not a configuration format")


def load_config(folder: str | Path, explicit: str | None = None, command: str = "extract", mode: str = "default") -> Config:
    path = find_config(folder, explicit)
    return create_config(read_config(path, command, mode) if path else {}, folder)


def define_config(config: Any) -> Any:
    """The configuration itself: for configuration modules that say what they define."""
    return config


_active: list[Config] = []


def set_active_config(config: Config) -> Config:
    """Makes a configuration the one that get_config() gives on this driver. Operators take theirs as a parameter."""
    _active[:] = [config]
    return config


def get_config() -> Config:
    """The active configuration; the defaults where none was set."""
    return _active[0] if _active else set_active_config(create_config())


def reset_config() -> Config:
    """The defaults become active again."""
    return set_active_config(create_config())
