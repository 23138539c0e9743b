"""Shared-storage access from the driver and from tasks (local, HDFS, S3, GCS paths)."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyarrow import fs


# Names that Hadoop gives to storage known here under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3"}
# Small files that are opened side by side.
SIDE_BY_SIDE = 32
# Suffixes that Spark's text reader unpacks; such files have no byte offsets to follow.
COMPRESSED = (".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate", ".xz")


def checked(spark, path: str) -> str:
    """``path``, or an error where Spark and this module would look for it in two places: a
    path without a scheme is Hadoop's default file system to Spark."""
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    if "://" not in path and not path.startswith("file:") and not default.startswith("file:"):
        raise ValueError(f"{path} needs a scheme: the default file system is {default}")
    return path


def is_data(name: str) -> bool:
    """The rule of Spark's readers: all files but hidden ones."""
    return not name.startswith(("_", "."))


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system a path lives on and the path within it."""
    if path.startswith("file:"):
        path = "/" + path[len("file:") :].lstrip("/")
    if "://" in path:
        scheme, rest = path.split("://", 1)
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}://{rest}")
    return fs.LocalFileSystem(), path


def exists(path: str) -> bool:
    system, inner = resolve(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound


def make_dir(path: str) -> None:
    system, inner = resolve(path)
    system.create_dir(inner, recursive=True)


def drop_dir(path: str) -> None:
    system, inner = resolve(path)
    if system.get_file_info(inner).type == fs.FileType.Directory:
        system.delete_dir(inner)


def children(path: str) -> list[str]:
    """Names directly below a folder; none where it does not exist."""
    system, inner = resolve(path)
    found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))
    return [info.base_name for info in found]


def sizes(path: str) -> dict[str, int]:
    """Size of each data file below a folder (hidden names left out), or of the one file."""
    system, inner = resolve(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return {inner: info.size}
    found = system.get_file_info(fs.FileSelector(inner, recursive=True, allow_not_found=True))
    return {
        i.path: i.size
        for i in found
        if i.type == fs.FileType.File and all(map(is_data, i.path[len(inner) :].strip("/").split("/")))
    }


def put_json(folder: str, name: str, value: dict) -> None:
    """Write a small record under a name of its own; it appears whole or not at all."""
    put_text(folder, f"{name}.json", [json.dumps(value)])


def put_text(folder: str, name: str, pieces: Iterable[str]) -> None:
    """A file that appears whole or not at all; one of that name is replaced."""
    system, inner = resolve(folder)
    system.create_dir(inner, recursive=True)
    hidden = f"{inner}/.{name}.tmp"
    with system.open_output_stream(hidden) as out:
        for piece in pieces:
            out.write(piece.encode())
    system.move(hidden, f"{inner}/{name}")


def create_json(spark, folder: str, name: str, value: dict) -> bool:
    """Like :func:`put_json`, but False where a record of that name exists already.

    Of several writers exactly one gets True: a hard link on a local file system, else
    Hadoop's rename without overwrite, which is atomic on HDFS. Object stores have no such
    step; there a store should have one writer.
    """
    system, inner = resolve(folder)
    system.create_dir(inner, recursive=True)
    hidden, final = f"{inner}/.{name}-{uuid.uuid4().hex}.tmp", f"{inner}/{name}.json"
    with system.open_output_stream(hidden) as out:
        out.write(json.dumps(value).encode())
    try:
        if isinstance(system, fs.LocalFileSystem):
            os.link(hidden, final)
            return True
        return _renamed(spark, folder.rstrip("/"), hidden.rsplit("/", 1)[1], f"{name}.json")
    except FileExistsError:
        return False
    finally:
        drop_file(f"{folder}/{hidden.rsplit('/', 1)[1]}")


def _renamed(spark, folder: str, old: str, new: str) -> bool:
    from py4j.protocol import Py4JJavaError

    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    hadoop = jvm.org.apache.hadoop.fs
    path = hadoop.Path(folder)
    context = hadoop.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = gateway.new_array(hadoop.Options.Rename, 1)
    options[0] = hadoop.Options.Rename.NONE
    try:
        context.rename(hadoop.Path(path, old), hadoop.Path(path, new), options)
    except Py4JJavaError as failure:
        if "FileAlreadyExists" in str(failure.java_exception):
            return False
        raise
    return True


def drop_file(path: str) -> None:
    system, inner = resolve(path)
    if system.get_file_info(inner).type == fs.FileType.File:
        system.delete_file(inner)


def names(folder: str) -> list[str]:
    """Names of the small records of a folder, in order."""
    return sorted(n[: -len(".json")] for n in children(folder) if n.endswith(".json") and not n.startswith("."))


def read_json(path: str) -> dict:
    return json.loads(read_text(path))


def get_json(folder: str, wanted: list[str] | None = None) -> dict[str, dict]:
    """Small records of a folder by name (all of them, or those ``wanted``), in that order."""
    chosen = names(folder) if wanted is None else wanted
    with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
        return dict(zip(chosen, pool.map(lambda n: read_json(f"{folder}/{n}.json"), chosen), strict=True))


def read_text(path: str) -> str:
    system, inner = resolve(path)
    with system.open_input_stream(inner) as source:
        return source.read().decode()
