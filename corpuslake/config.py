"""Settings from a TOML file, with environment variables filled in."""

from __future__ import annotations

import os
import re
import tomllib
from pathlib import Path
from typing import Any

NAME = "config.toml"
_VARIABLE = re.compile(r"\$\{(\w+)(?::-([^}]*))?\}")


def find_config(path: str | None = None) -> Path:
    """``path`` as it is, else ``config.toml`` of the working folder or of the repository."""
    if path:
        return Path(path)
    for folder in (Path.cwd(), Path(__file__).resolve().parent.parent):
        if (folder / NAME).is_file():
            return folder / NAME
    raise FileNotFoundError(NAME)


def filled(value: Any) -> Any:
    """``${NAME}`` and ``${NAME:-default}`` replaced in all strings; a set but empty variable stays empty."""
    if isinstance(value, dict):
        return {k: filled(v) for k, v in value.items()}
    if isinstance(value, list):
        return [filled(v) for v in value]
    if isinstance(value, str):
        return _VARIABLE.sub(lambda m: os.environ.get(m[1], m[2] or ""), value)
    return value


def load_config(path: str | None = None) -> dict:
    where = find_config(path)
    with open(where, "rb") as file:
        return filled(tomllib.load(file)) | {"__folder__": str(where.resolve().parent)}


def setting(config: dict, dotted: str, default: Any = None) -> Any:
    """The value at ``a.b.c``; ``default`` where a part is missing."""
    for part in dotted.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config


def resolved(config: dict, path: str) -> str:
    """``path``, relative to the folder of the settings file; URIs and absolute paths stay."""
    return path if "://" in path or os.path.isabs(path) else os.path.join(config.get("__folder__", "."), path)
