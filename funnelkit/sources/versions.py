"""Several tables published together: versioned folders and a manifest written last.

A job writes all its tables below a new folder ``v-<id>``. ``publish`` then adds one
small manifest that names them; it is written under another name and renamed,
so it is there whole or not at all. Readers take the manifest with the highest
number. A job that dies between two tables, or before its manifest, leaves the
version before it readable and its own folder unseen until ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

_MANIFESTS = "_manifests"


def _fs(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def _children(spark: SparkSession, path: str) -> list[str]:
    fs, target = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(target)) if fs.exists(target) else []


def _numbers(spark: SparkSession, out_dir: str) -> list[int]:
    names = _children(spark, f"{out_dir}/{_MANIFESTS}")
    return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _manifest(spark: SparkSession, out_dir: str, number: int) -> dict:
    rows = spark.read.text(f"{out_dir}/{_MANIFESTS}/{number:012d}.json", wholetext=True).collect()
    return json.loads(rows[0][0])


def new_version(out_dir: str) -> str:
    """A fresh folder for one version's tables."""
    return f"{out_dir.rstrip('/')}/v-{uuid.uuid4().hex}"


def publish(spark: SparkSession, out_dir: str, paths: dict[str, str]) -> int:
    """Make ``paths`` (table name to folder below ``out_dir``) the current version.

    Returns its number. Two jobs that publish at once get different numbers or
    one of them fails; none overwrites the other's manifest.
    """
    base = out_dir.rstrip("/")
    outside = [p for p in paths.values() if not p.startswith(base + "/")]
    if outside:
        raise ValueError("not below the output folder: " + ", ".join(outside))
    number = max(_numbers(spark, base), default=0) + 1
    fs, draft = _fs(spark, f"{base}/{_MANIFESTS}/.draft-{uuid.uuid4().hex}")
    stream = fs.create(draft, False)
    # relative paths, so that the whole folder can be moved
    stream.writeBytes(json.dumps({name: p[len(base) + 1:] for name, p in paths.items()}))
    stream.close()
    target = _fs(spark, f"{base}/{_MANIFESTS}/{number:012d}.json")[1]
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise RuntimeError(f"version {number} of {base} was published by another job")
    return number


def published(spark: SparkSession, out_dir: str) -> dict[str, str]:
    """Table name to path of the current version; an error if there is none."""
    base = out_dir.rstrip("/")
    numbers = _numbers(spark, base)
    if not numbers:
        raise FileNotFoundError(f"nothing is published in {base}")
    return {name: f"{base}/{p}" for name, p in _manifest(spark, base, numbers[-1]).items()}


def vacuum(spark: SparkSession, out_dir: str, keep: int = 2) -> list[str]:
    """Delete version folders that none of the last ``keep`` manifests names; their names.

    Not to be run while a job writes a version.
    """
    if keep < 1:
        raise ValueError("the current version stays")
    base = out_dir.rstrip("/")
    numbers = _numbers(spark, base)
    used = {p.split("/")[0] for n in numbers[-keep:] for p in _manifest(spark, base, n).values()}
    gone = [n for n in _children(spark, base) if n.startswith("v-") and n not in used]
    for name in gone + [f"{_MANIFESTS}/{n:012d}.json" for n in numbers[:-keep]]:
        fs, target = _fs(spark, f"{base}/{name}")
        fs.delete(target, True)
    return gone
