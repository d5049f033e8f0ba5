"""Small files on whatever file system a path names, through Hadoop, and tables laid out in stored buckets."""

from __future__ import annotations

import hashlib
import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Storage:
    """File operations of the driver; what is read or written here is small (manifests, models, reports)."""

    def __init__(self, spark: SparkSession):
        self._jvm, self._conf = spark._jvm, spark._jsc.hadoopConfiguration()

    def _open(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self._conf), at

    def exists(self, path: str) -> bool:
        system, at = self._open(path)
        return system.exists(at)

    def is_folder(self, path: str) -> bool:
        system, at = self._open(path)
        return system.exists(at) and system.getFileStatus(at).isDirectory()

    def listing(self, path: str) -> list[list]:
        """[relative name, bytes, modification stamp] of the files at or below a path, by name; hidden files don't count."""
        system, at = self._open(path)
        if not system.exists(at):
            return []
        root, found = system.getFileStatus(at).getPath().toString(), []
        files = system.listFiles(at, True)
        while files.hasNext():
            status = files.next()
            name = status.getPath().toString()[len(root) :].lstrip("/") or status.getPath().getName()
            if not any(part[0] in "._" for part in name.split("/")):
                found.append([name, status.getLen(), status.getModificationTime()])
        return sorted(found)

    def read(self, path: str) -> bytes:
        """Raises OSError where the file is missing or fails its checksum."""
        system, at = self._open(path)
        try:
            stream = system.open(at)
            try:
                return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
            finally:
                stream.close()
        except Py4JJavaError as wrong:
            raise OSError(f"cannot read {path}: {wrong.java_exception.getMessage()}") from wrong

    def write(self, path: str, data: bytes) -> None:
        """Writes beside the path and moves there, so that readers see the old file, none, or the new one whole."""
        beside = f"{path}.{uuid.uuid4().hex}.new"
        system, at = self._open(beside)
        stream = system.create(at, True)
        try:
            stream.write(bytearray(data))
        finally:
            stream.close()
        self.move(beside, path)

    def read_json(self, path: str) -> Any:
        return json.loads(self.read(path))

    def write_json(self, path: str, value: Any) -> None:
        self.write(path, json.dumps(value, ensure_ascii=False, sort_keys=True).encode())

    def move(self, path: str, to: str) -> None:
        """Moves a file or folder over what is at `to`."""
        system, at = self._open(path)
        goal = self._jvm.org.apache.hadoop.fs.Path(to)
        if goal.getParent() is not None:
            system.mkdirs(goal.getParent())
        system.delete(goal, True)
        if not system.rename(at, goal):
            raise OSError(f"cannot move {path} to {to}")

    def drop(self, path: str) -> None:
        system, at = self._open(path)
        system.delete(at, True)

    def content_id(self, path: str) -> str:
        """Hash of names and bytes below a path, wherever it lies; for artifacts of bounded size (models, policies).

        A file that fails its checksum gives an id that no whole folder has.
        """
        found = hashlib.blake2b(digest_size=16)
        folder = self.is_folder(path)
        for name, size, _ in self.listing(path):
            found.update(f"{name if folder else ''}\x00{size}\x00".encode())
            try:
                found.update(self.read(f"{path}/{name}" if folder else path))
            except OSError:
                return f"damaged {name}"
        return found.hexdigest()
