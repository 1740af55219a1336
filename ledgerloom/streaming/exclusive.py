"""Files that exactly one of several writers creates."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import SparkSession


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create ``path`` with ``text``, whole; False if it is there already.

    Hadoop's local file system looks before it creates, so two writers can both
    succeed; there a finished file is linked to its name, which fails if the name is taken.  Other
    file systems must create without overwriting atomically, as HDFS does.
    """
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    place = urlparse(store.makeQualified(target).toString())
    if place.scheme == "file":
        name = unquote(place.path)
        os.makedirs(os.path.dirname(name), exist_ok=True)
        own = f"{os.path.dirname(name)}/.{uuid.uuid4().hex}"
        try:
            with open(own, "x", encoding="utf-8") as out:
                out.write(text)
                out.flush()
                os.fsync(out.fileno())
            os.link(own, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(own)
    store.mkdirs(target.getParent())
    try:
        out = store.create(target, False)
    except Exception:
        if store.exists(target):
            return False
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True
