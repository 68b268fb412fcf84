"""Durable stages. A stage is a folder under a root that outlives the
application, named by its input files, its parameters and the library's own
code. An attempt writes into a folder of its own; the manifest, put in place
by one rename, names the attempt that counts. A later session with the same
key reads it, and any change of input, parameters or code makes another key.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import SparkSession

from histscore.session import checkpoint_dir

MANIFEST = "manifest.json"


def stage_root(spark: SparkSession) -> str:
    """``spark.histscore.stage.dir``, else ``stages`` in the configured
    ``spark.checkpoint.dir`` (not the application's own folder in it)."""
    named = spark.conf.get("spark.histscore.stage.dir", None)
    shared = spark.conf.get("spark.checkpoint.dir", None) or posixpath.dirname(checkpoint_dir(spark))
    return named or posixpath.join(shared, "stages")


@cache
def code_key() -> str:
    """A hash of the library's sources (its training-data operators apart)."""
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    seen = hashlib.sha1()
    for folder in ("functions", "operators", "plans", "sources"):
        for name in sorted(os.listdir(os.path.join(top, folder))):
            if name.endswith(".py"):
                with open(os.path.join(top, folder, name), "rb") as f:
                    seen.update(f.read())
    return seen.hexdigest()


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def _read(spark: SparkSession, path: str) -> dict | None:
    fs, place = _fs(spark, path)
    if not fs.exists(place):
        return None
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def stage(spark: SparkSession, name: str, key: dict, build: Callable[[str], None]) -> str:
    """The folder of the committed attempt for ``key``; ``build(folder)``
    writes a new one where there is none."""
    whole = json.dumps({**key, "code": code_key()}, sort_keys=True, default=str)
    root = posixpath.join(stage_root(spark), name, hashlib.sha1(whole.encode()).hexdigest()[:16])
    manifest = posixpath.join(root, MANIFEST)
    found = _read(spark, manifest)
    if found is None:
        attempt = posixpath.join(root, f"attempt-{uuid.uuid4().hex}")
        build(attempt)
        fs, place = _fs(spark, attempt + "-" + MANIFEST)
        out = fs.create(place, True)
        out.write(bytearray(json.dumps({"key": json.loads(whole), "data": attempt}).encode()))
        out.close()
        _, final = _fs(spark, manifest)
        if not fs.exists(final):  # the first attempt to commit counts
            fs.rename(place, final)
        found = _read(spark, manifest)
    return found["data"]
