"""Sinks.  Spark's commit protocol makes distributed writes atomic; small driver-side files are replaced whole."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode and an error on a cluster."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all machines share")
        shared = tempfile.mkdtemp(prefix="covarium-")
    return f"{shared.rstrip('/')}/scratch-{uuid.uuid4().hex}"


def parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).parquet(path)


def csv(df: DataFrame, path: str, mode: str = "errorifexists", one_file: bool = True) -> None:
    """CSV with a header; one file for small results, without which partitions stay as they are."""
    (df.coalesce(1) if one_file else df).write.mode(mode).option("header", True).csv(path)


def text(path: str | Path, content: str) -> None:
    """Write, flush, then replace."""
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    handle, name = tempfile.mkstemp(dir=target.parent, prefix=".tmp-")
    with os.fdopen(handle, "w", encoding="utf-8") as f:
        f.write(content)
        f.flush()
        os.fsync(f.fileno())
    os.replace(name, target)


def json_file(path: str | Path, value: Any) -> None:
    text(path, json.dumps(value, indent=2, sort_keys=True, ensure_ascii=False) + "\n")


def freeze(path: str | Path, content: bytes) -> None:
    """Write once: other bytes that are already there are an error."""
    target = Path(path)
    if target.exists():
        if target.read_bytes() != content:
            raise FileExistsError(f"{target} is frozen with other content")
        return
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_bytes(content)


def inside(root: str | Path, path: str | Path) -> Path:
    """The resolved path; an error where it leaves ``root``."""
    found = (Path(root) / path).resolve()
    if not found.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside {root}")
    return found
