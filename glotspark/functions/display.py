"""Durations and progress for people."""

from __future__ import annotations

import math


def format_duration(ms: float) -> str:
    if not math.isfinite(ms) or ms <= 0:
        return "0s"
    hours, rest = divmod(math.floor(ms / 1000 + 0.5), 3600)
    minutes, seconds = divmod(rest, 60)
    return " ".join([f"{hours}h"] * (hours > 0) + [f"{minutes}m"] * (hours > 0 or minutes > 0) + [f"{seconds}s"])


def format_progress(done: int, total: int, width: int = 20) -> str:
    if total <= 0:
        return f"[{'█' * width}] 100.0% (0/0)"
    done = min(max(done, 0), total)
    full = min(width, done * width // total)
    return f"[{'█' * full}{'░' * (width - full)}] {done / total * 100:.1f}% ({done}/{total})"
