"""Files as executors read and write them: local paths, and whatever ``pyarrow.fs`` knows by its scheme."""

from __future__ import annotations

import os
import shutil
from typing import BinaryIO
from urllib.parse import unquote, urlparse


def local(path: str) -> str | None:
    """The path of this machine (or of a folder that all machines mount), if it is one."""
    if path.startswith("file:"):
        return unquote(urlparse(path).path)
    return None if "://" in path else path


def known(path: str) -> bool:
    """Whether executors can open the path by themselves; other stores are Spark's and the driver's."""
    return local(path) is not None or urlparse(path).scheme in ("hdfs", "s3", "gs", "gcs", "abfs", "abfss")


def _remote(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def reader(path: str) -> BinaryIO:
    if own := local(path):
        return open(own, "rb")
    system, at = _remote(path)
    return system.open_input_file(at)


def writer(path: str) -> BinaryIO:
    """A new file; folders above it are made."""
    if own := local(path):
        os.makedirs(os.path.dirname(own), exist_ok=True)
        return open(own, "wb")
    system, at = _remote(path)
    system.create_dir(at.rpartition("/")[0], recursive=True)
    return system.open_output_stream(at)


def exists(path: str) -> bool:
    if own := local(path):
        return os.path.exists(own)
    from pyarrow import fs

    system, at = _remote(path)
    return system.get_file_info(at).type != fs.FileType.NotFound


def entries(path: str) -> list[tuple[str, bool, int]]:
    """(name, whether it is a folder, size) of what is in a folder; nothing if it is not there."""
    if own := local(path):
        return sorted((e.name, e.is_dir(), 0 if e.is_dir() else e.stat().st_size) for e in os.scandir(own)) if os.path.isdir(own) else []
    from pyarrow import fs

    system, at = _remote(path)
    found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
    return sorted((f.base_name, f.type == fs.FileType.Directory, f.size or 0) for f in found)


def folders(path: str) -> list[str]:
    """Names of the folders in a folder; none if it is not there."""
    return [name for name, folder, _ in entries(path) if folder]


def move(path: str, target: str) -> bool:
    """Give a folder a new name; False if that is taken."""
    if own := local(path):
        to = local(target)
        os.makedirs(os.path.dirname(to), exist_ok=True)
        try:
            os.rename(own, to)  # onto a folder with files this fails
        except OSError:
            if not os.path.isdir(to):
                raise
            return False
        return True
    if exists(target):
        return False
    system, at = _remote(path)
    to = _remote(target)[1]
    system.create_dir(to.rpartition("/")[0], recursive=True)
    system.move(at, to)
    return True


def remove(path: str) -> None:
    if own := local(path):
        shutil.rmtree(own, ignore_errors=True)
    elif exists(path):
        system, at = _remote(path)
        system.delete_dir(at)
