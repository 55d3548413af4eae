"""Versioned artefacts: a version is written beside the others and then named the current one.

``root/v-<id>/`` holds a version; ``root/_versions/<number>.json`` names them in order. Naming is one small
file that is created and never changed, so it works on any Hadoop file system, also where renaming isn't
atomic: readers see the last complete version, a writer that fails names nothing, and of two writers at
once each gets a number of its own.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

NAMES = "_versions"


def _path(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    place, fs = _path(spark, path)
    stream = fs.open(place)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file; False if there is one."""
    from py4j.protocol import Py4JJavaError

    place, fs = _path(spark, path)
    try:
        stream = fs.create(place, False)
    except Py4JJavaError:
        if fs.exists(place):
            return False
        raise
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    return True


def versions(spark: SparkSession, root: str) -> list[dict]:
    """The named versions, oldest first: ``number``, ``path`` and what was noted about them. A name that
    is still being written doesn't count."""
    place, fs = _path(spark, f"{root.rstrip('/')}/{NAMES}")
    if not fs.exists(place):
        return []
    out = []
    for status in fs.listStatus(place):
        name = status.getPath().getName()
        if not name.endswith(".json"):
            continue
        try:
            out.append({"number": int(name[:-5]), **json.loads(_read(spark, status.getPath().toString()))})
        except ValueError:
            continue
    return sorted(out, key=lambda v: v["number"])


def current(spark: SparkSession, root: str) -> str:
    """Path of the current version; ``FileNotFoundError`` if there is none."""
    found = versions(spark, root)
    if not found:
        raise FileNotFoundError(f"No version of {root}")
    return f"{root.rstrip('/')}/{found[-1]['path']}"


def publish(spark: SparkSession, root: str, write: Callable[[str], object], about: dict | None = None) -> str:
    """Have ``write(path)`` write a new version and make it the current one; returns its path.

    ``write`` may write several things under ``path``: they become current together. If it raises,
    what it left behind is removed and the version before stays current.
    """
    root = root.rstrip("/")
    name = f"v-{uuid.uuid4().hex}"
    try:
        write(f"{root}/{name}")
    except BaseException:
        place, fs = _path(spark, f"{root}/{name}")
        fs.delete(place, True)
        raise
    number = (versions(spark, root) or [{"number": 0}])[-1]["number"] + 1
    while not _write_new(spark, f"{root}/{NAMES}/{number:010d}.json", json.dumps({"path": name, **(about or {})})):
        number += 1
    return f"{root}/{name}"


def drop_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Remove all but the last ``keep`` named versions; returns how many. A version's name goes first."""
    if keep < 1:
        raise ValueError("keep must be >= 1")
    old = versions(spark, root)[:-keep]
    for v in old:
        for path in (f"{root.rstrip('/')}/{NAMES}/{v['number']:010d}.json", f"{root.rstrip('/')}/{v['path']}"):
            place, fs = _path(spark, path)
            fs.delete(place, True)
    return len(old)
