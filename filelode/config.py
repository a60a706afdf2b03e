"""Settings: an argument, else the environment, else the project's file, else the user's, else a default."""

from __future__ import annotations

import os
import tomllib
from pathlib import Path
from typing import Any

PREFIX = "FILELODE_"


def merged(base: dict, over: dict) -> dict:
    """``over`` laid on ``base``: tables are merged, everything else, lists too, is replaced."""
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, dict) and isinstance(out.get(key), dict) else value
    return out


def load(project: str | Path | None = None, user: str | Path | None = None, defaults: dict | None = None) -> dict:
    settings = defaults or {}
    for path in (user, project):
        if path is not None and Path(path).is_file():
            settings = merged(settings, tomllib.loads(Path(path).read_text()))
    return settings


def setting(name: str, explicit: Any = None, settings: dict | None = None, default: Any = None) -> Any:
    """``name`` is a dotted path in the settings; its environment variable has underscores for dots."""
    if explicit is not None:
        return explicit
    if (held := os.environ.get(PREFIX + name.upper().replace(".", "_"))) is not None:
        return held
    found: Any = settings or {}
    for part in name.split("."):
        found = found.get(part) if isinstance(found, dict) else None
    return default if found is None else found


def truthy(text: str | None) -> bool:
    return (text or "").strip().lower() in ("1", "true", "t", "yes", "y", "on")
