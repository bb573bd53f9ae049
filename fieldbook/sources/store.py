"""Tables that Spark derives from the given ones, written once to the shared folder and read from there."""

from __future__ import annotations

import hashlib
import json
import re
import tempfile
import uuid
from collections.abc import Callable
from functools import lru_cache
from pathlib import Path

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is taken in local mode; on a cluster that would be one machine's, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fieldbook-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """A new folder, by name only, in the shared one."""
    return f"{shared_folder(spark)}/fieldbook-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written to the shared folder and read from there: lineage is cut and the size is known."""
    path = f"{scratch(df.sparkSession)}/{name}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _there(spark: SparkSession, path: str) -> bool:
    """Whether a written table is whole and hasn't been removed meanwhile."""
    done, fs = _fs(spark, f"{path}/_SUCCESS")
    return fs.exists(done)


@lru_cache(maxsize=1)
def _code() -> str:
    """A digest of this library's own modules: a table made by other code isn't taken for this code's."""
    root = Path(__file__).resolve().parents[1]
    own = hashlib.sha256()
    for f in sorted(root.rglob("*.py")):
        own.update(f.relative_to(root).as_posix().encode() + f.read_bytes())
    return own.hexdigest()


def fingerprint(spark: SparkSession, source: str) -> str:
    """Names, sizes and times of all files under a folder, as one digest: three levels of folders, a call for each."""
    stated = []
    for depth in ("", "/*", "/*/*", "/*/*/*"):
        path, fs = _fs(spark, source + depth)
        stated.append(spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString(fs.globStatus(path)))
    return hashlib.sha256(re.sub(r"access_time=\d+", "", "".join(stated)).encode()).hexdigest()


def manifest(spark: SparkSession, path: str) -> dict[str, str]:
    """What a stored table was made from; empty if there is none or it is damaged."""
    where, fs = _fs(spark, f"{path}/_manifest.json")
    if not fs.exists(where):
        return {}
    stream = fs.open(where)
    try:
        return json.loads(bytes(stream.readAllBytes()))
    except (ValueError, Py4JJavaError):
        return {}
    finally:
        stream.close()


def build_once(spark: SparkSession, path: str, make: Callable[[], DataFrame], source: str | None = None, rebuild: bool = False, by: str | None = None, code: str = "") -> DataFrame:
    """The table under ``path``, made if it isn't there, on request, or if its manifest tells of other source files or other code.

    It is made beside its place, which it takes when it is whole; the manifest comes last. So a run that dies leaves a table that the next one makes anew.
    """
    wanted = {"source": source or "", "fingerprint": fingerprint(spark, source) if source else "", "code": code}
    if not rebuild and _there(spark, path) and (not source or manifest(spark, path) == wanted):
        return spark.read.parquet(path)
    beside = f"{scratch(spark)}/made"
    writer = make().write
    (writer.partitionBy(by) if by else writer).parquet(beside)
    place, fs = _fs(spark, path)
    fs.delete(place, True)
    fs.mkdirs(place.getParent())
    if not fs.rename(_fs(spark, beside)[0], place):
        raise OSError(f"{beside} can't be moved to {path}")
    out = fs.create(_fs(spark, f"{path}/_manifest.json")[0], True)
    out.write(bytearray(json.dumps(wanted).encode()))
    out.close()
    return spark.read.parquet(path)


def _place(spark: SparkSession, source: str, name: str) -> str:
    state = hashlib.sha256(f"{source}\0{fingerprint(spark, source)}\0{_code()}".encode()).hexdigest()[:24]
    return f"{shared_folder(spark)}/fieldbook-stored-{state}/{name}"


def is_stored(spark: SparkSession, source: str, name: str) -> bool:
    """Whether a table is there already."""
    return _there(spark, _place(spark, source, name))


def stored(spark: SparkSession, source: str, name: str, make: Callable[[], DataFrame], by: str | None = None) -> DataFrame:
    """``make()``, written the first time that it is asked for, perhaps in folders of the column ``by``.

    Its place in the shared folder follows from the source, the state of its files and this library's code, so any session that shares the folder finds it, and source files
    that change lead to another place: no table answers for files that it wasn't made from. Sizes of what is read back are known, so
    Spark chooses joins by them.
    """
    return build_once(spark, _place(spark, source, name), make, by=by)
