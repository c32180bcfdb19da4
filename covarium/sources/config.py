"""YAML configuration with required sections and frozen values."""

from __future__ import annotations

import hashlib
import json
import platform
import sys
from importlib import metadata
from pathlib import Path
from typing import Any

import yaml


class ConfigError(ValueError):
    """A configuration lacks a section or changes a frozen value."""


def load(path: str | Path, sections: tuple[str, ...] = (), frozen: dict[str, Any] | None = None) -> dict:
    """The mapping in a YAML file; ``frozen`` has dotted names and the values they must have."""
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8"))
    if not isinstance(value, dict):
        raise ConfigError(f"{path} holds no mapping")
    missing = [s for s in sections if not isinstance(value.get(s), dict)]
    if missing:
        raise ConfigError(f"sections are missing: {missing}")
    for name, want in (frozen or {}).items():
        at: Any = value
        for part in name.split("."):
            at = at.get(part) if isinstance(at, dict) else None
        if type(at) is not type(want) or at != want:
            raise ConfigError(f"{name} is {at!r}, not {want!r}")
    return value


def config_hash(value: Any) -> str:
    """SHA-256 of compact JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False).encode()).hexdigest()


def environment(spark=None, packages: tuple[str, ...] = ("pyspark", "numpy", "pandas", "pyarrow")) -> dict:
    """Versions and platform; with a session, Spark's settings too."""
    versions = {}
    for p in packages:
        try:
            versions[p] = metadata.version(p)
        except metadata.PackageNotFoundError:
            versions[p] = None
    out = {"python": sys.version.split()[0], "platform": platform.platform(), "machine": platform.machine(), "packages": versions}
    return out | ({"spark": spark.version, "master": spark.sparkContext.master} if spark else {})
