"""Numbered versions of a stored table, published by compare-and-set.

``base/versions/<number>/manifest.json`` describes version ``number``; readers
take the highest. A writer that worked from version n publishes n + 1: it
writes its manifest into a folder of its own and renames the folder to the
number. Of several writers one rename creates the number; the others find it
taken and get ``Conflict``, so no version is ever replaced and no update is
lost. Renaming a folder to a new name must be atomic, as on HDFS or a POSIX
file system; what stands at the number is read back, since a rename onto an
existing folder may move into it instead of failing.

Only manifests (a few kB) pass through the driver.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.sql import SparkSession


class Conflict(RuntimeError):
    """Another writer published the version first."""


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system of a path, and the path for it."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> dict:
    fs, p = file_system(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def _numbers(spark: SparkSession, base: str) -> dict[int, int]:
    """Published number -> time of publishing (ms)."""
    fs, p = file_system(spark, f"{base}/versions")
    if not fs.exists(p):
        return {}
    return {int(s.getPath().getName()): s.getModificationTime() for s in fs.listStatus(p) if s.getPath().getName().isdigit()}


def _folder(base: str, number: int) -> str:
    return f"{base}/versions/{number:010d}"


def latest(spark: SparkSession, base: str) -> tuple[int, dict | None]:
    """(number, manifest) of the newest version; (0, None) for a new path."""
    number = max(_numbers(spark, base), default=0)
    return number, _read(spark, f"{_folder(base, number)}/manifest.json") if number else None


def version(spark: SparkSession, base: str, number: int) -> tuple[int, dict | None]:
    """(number, manifest) of one version, (number, None) if there is none."""
    fs, p = file_system(spark, _folder(base, number))
    return number, _read(spark, f"{_folder(base, number)}/manifest.json") if fs.exists(p) else None


def publish(spark: SparkSession, base: str, number: int, manifest: dict) -> None:
    """Make ``manifest`` version ``number``, or raise ``Conflict`` where that number is taken."""
    writer = uuid.uuid4().hex
    staging, target = f"{base}/staging-{writer}", _folder(base, number)
    fs, p = file_system(spark, f"{staging}/manifest.json")
    stream = fs.create(p, False)
    try:
        stream.write(json.dumps({**manifest, "writer": writer}).encode())
    finally:
        stream.close()
    fs.mkdirs(file_system(spark, f"{base}/versions")[1])
    source, goal = file_system(spark, staging)[1], file_system(spark, target)[1]
    if not fs.exists(goal):
        try:
            fs.rename(source, goal)
        except Exception:  # some file systems raise where others return false; what stands there decides
            if not fs.exists(goal):
                raise
    if not fs.exists(goal) or _read(spark, f"{target}/manifest.json")["writer"] != writer:
        for left in (source, file_system(spark, f"{target}/staging-{writer}")[1]):
            fs.delete(left, True)
        raise Conflict(f"version {number} of {base} was published by another writer")


def remove_old(spark: SparkSession, base: str, grace_s: float, parts: str, used) -> list[str]:
    """Delete versions older than the newest once ``grace_s`` seconds have passed since a newer one was published, and
    the folders under ``base/parts`` that no version left names (``used(manifest)``) and that are as old.

    Returns what was deleted. Readers that opened a version may work on it for the grace time.
    """
    limit = time.time() * 1000 - grace_s * 1000
    fs = file_system(spark, base)[0]
    numbers = _numbers(spark, base)
    order, gone = sorted(numbers), []
    for number, follower in zip(order, order[1:]):
        if numbers[follower] <= limit:
            gone.append(_folder(base, number))
            order = [k for k in order if k != number]
    named = {x for k in order for x in used(_read(spark, f"{_folder(base, k)}/manifest.json"))}
    p = file_system(spark, f"{base}/{parts}")[1]
    if fs.exists(p):
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name not in named and s.getModificationTime() <= limit:  # unnamed and new: a writer is at work on it
                gone.append(f"{base}/{parts}/{name}")
    for path in gone:
        fs.delete(file_system(spark, path)[1], True)
    return gone
