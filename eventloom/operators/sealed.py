"""Versions of a stored table: a folder each, committed by a metadata file that is written last.

A reader takes the newest committed version, so a writer that dies leaves what stood before it whole.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

META = "meta.json"


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def folders(spark: SparkSession, path: str, prefix: str) -> list[str]:
    """Names of the folders in ``path`` that begin with ``prefix``, ascending: one call, however many there are."""
    fs, at = _fs(spark, path)
    if not fs.exists(at):
        return []
    return sorted(n for s in fs.listStatus(at) if s.isDirectory() and (n := s.getPath().getName()).startswith(prefix))


def current(spark: SparkSession, path: str) -> str | None:
    """The folder of the newest committed version."""
    for name in reversed(folders(spark, path, "v=")):
        fs, at = _fs(spark, f"{path}/{name}/{META}")
        if fs.exists(at):
            return f"{path}/{name}"
    return None


def fresh(spark: SparkSession, path: str, mode: str) -> str | None:
    """A folder for a new version; None if ``mode`` is ignore and there is one."""
    if mode not in ("error", "errorifexists", "overwrite", "ignore"):
        raise ValueError(f"mode {mode}: a sealed table is written whole")
    there = current(spark, path)
    if there and mode == "ignore":
        return None
    if there and mode != "overwrite":
        raise FileExistsError(f"{path} exists already")
    last = folders(spark, path, "v=")
    number = int(last[-1][2:10]) + 1 if last else 1
    return f"{path}/v={number:08d}-{uuid.uuid4().hex[:8]}"


def commit(spark: SparkSession, at: str, meta: dict) -> None:
    """From here on ``at`` is the newest version; the others go."""
    fs, tmp = _fs(spark, f"{at}/{META}.tmp")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(meta).encode()))
    out.close()
    fs.rename(tmp, _fs(spark, f"{at}/{META}")[1])
    path, own = at.rsplit("/", 1)
    for name in folders(spark, path, "v="):
        if name != own:
            fs.delete(_fs(spark, f"{path}/{name}")[1], True)


def meta(spark: SparkSession, at: str) -> dict:
    return json.loads(spark.read.text(f"{at}/{META}", wholetext=True).first()[0])
