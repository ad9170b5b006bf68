"""Archive paths and sample names, resolved through Hadoop's file systems."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession


def hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


#: folders of applications that name none
_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, it becomes a temporary folder if driver and executor are one process, and is an error otherwise."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="strandmark-")
        root = _LOCAL[app]
    return root.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return bool(fs.exists(p))


def delete(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return bool(fs.delete(p, True))


def rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = hadoop(spark, old)
    if not fs.rename(p, spark._jvm.org.apache.hadoop.fs.Path(new)):
        raise OSError(f"cannot move {old} to {new}")


def size_of(spark: SparkSession, path: str) -> int:
    fs, p = hadoop(spark, path)
    return fs.getContentSummary(p).getLength() if fs.exists(p) else 0


def sample_name(path: str) -> str:
    """Base name without .ch3 and then without a trailing shard number."""
    base = path.rstrip("/").rsplit("/", 1)[-1]
    return re.sub(r"-\d+$", "", re.sub(r"\.ch3$", "", base, flags=re.IGNORECASE))


def resolve(spark: SparkSession, files: str | Sequence[str] | Mapping[str, str]) -> list[tuple[str, str]]:
    """(sample, path) of each archive. Directories hold *.ch3, not searched deeper; NAME=PATH or a mapping names a sample."""
    if isinstance(files, Mapping):
        items = list(files.items())
    else:
        items = []
        for f in [files] if isinstance(files, str) else files:
            name, eq, rest = f.partition("=")
            named = eq and "/" not in name and (re.match(r"[A-Za-z][\w+.-]*:", rest) or not exists(spark, f))
            items.append((name, rest) if named else (None, f))
    out = []
    for name, path in items:
        fs, p = hadoop(spark, path)
        if not fs.exists(p):
            raise FileNotFoundError(path)
        if fs.getFileStatus(p).isDirectory():
            found = sorted(str(s.getPath().toString()) for s in fs.listStatus(p) if s.getPath().getName().lower().endswith(".ch3"))
            if not found:
                raise FileNotFoundError(f"no .ch3 files in {path}")
        else:
            found = [str(fs.getFileStatus(p).getPath().toString())]
        out += [(name or sample_name(f), f) for f in found]
    return out


def write_text(spark: SparkSession, path: str, text: str) -> None:
    fs, p = hadoop(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
