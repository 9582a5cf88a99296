"""Versions of a folder: immutable parts, and manifests that appear by one rename.

A version is ``versions/<number>.json`` and lists the parts that belong to it.
Writers put their parts down first and publish last; a part that no manifest
lists doesn't exist for readers, so a job that fails in between leaves nothing
to see.  Two writers of one version can't both succeed: the rename refuses an
existing name.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession


class Taken(RuntimeError):
    """Another writer has published the version."""


def _at(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def versions(spark: SparkSession, path: str) -> list[int]:
    """All published versions, ascending; none where there is no folder."""
    p, fs = _at(spark, f"{path}/versions")
    if not fs.exists(p):
        return []
    return sorted(int(m[1]) for f in fs.listStatus(p) if (m := re.fullmatch(r"(\d+)\.json", f.getPath().getName())))


def read(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """A version's manifest, the latest if none is named; None if there is no such version."""
    known = versions(spark, path)
    version = version or (known[-1] if known else None)
    if version not in known:
        return None
    p, fs = _at(spark, f"{path}/versions/{version:012}.json")
    stream = fs.open(p)
    try:
        return json.loads(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def publish(spark: SparkSession, path: str, manifest: dict) -> None:
    """Makes ``manifest`` the version that it names, whole or not at all."""
    jvm = spark.sparkContext._jvm
    temporary, fs = _at(spark, f"{path}/versions/_{uuid.uuid4().hex}")
    target, _ = _at(spark, f"{path}/versions/{manifest['version']:012}.json")
    out = fs.create(temporary)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    refuse = spark.sparkContext._gateway.new_array(rename, 1)
    refuse[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(temporary, target, refuse)
    except Exception as e:
        fs.delete(temporary, False)
        if "FileAlreadyExists" in str(e):
            raise Taken(f"version {manifest['version']} of {path} is there already") from None
        raise


def advance(spark: SparkSession, path: str, change: Callable[[dict | None], dict], tries: int = 20) -> dict:
    """Publishes ``change`` of the latest manifest as the next version; anew from the then latest where another writer was faster."""
    for _ in range(tries):
        last = read(spark, path)
        manifest = change(last) | {"version": (last["version"] if last else 0) + 1}
        try:
            publish(spark, path, manifest)
            return manifest
        except Taken:
            continue
    raise Taken(f"{path} changed {tries} times meanwhile")
