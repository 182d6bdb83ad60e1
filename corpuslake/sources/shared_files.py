"""Small files on any file system that Spark reaches: lists, contents, exclusive and replacing writes."""

from __future__ import annotations

import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class SharedFiles:
    """Small files under ``folder``, read and written by the driver."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._fs = self.path("x").getFileSystem(self._conf)

    @property
    def _conf(self):
        return self.spark._jsc.hadoopConfiguration()

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def names(self, pattern: str) -> list[str]:
        """Names that match a glob, in order."""
        return sorted(f.getPath().getName() for f in self._fs.globStatus(self.path(pattern)) or [])

    def text(self, name: str) -> str | None:
        """A file's content; None if there is no such file."""
        try:
            stream = self._fs.open(self.path(name))
        except Py4JJavaError as error:
            if "FileNotFoundException" in error.java_exception.getClass().getName():
                return None
            raise
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def _stored(self, said: str) -> str:
        name = f".writing-{uuid.uuid4().hex}"
        stream = self._fs.create(self.path(name), False)
        stream.write(bytearray(said.encode()))
        stream.close()
        return name

    def _renamed(self, name: str, new: str, how: str) -> None:
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        kinds = self.spark._sc._gateway.new_array(hadoop.Options.Rename, 1)
        kinds[0] = getattr(hadoop.Options.Rename, how)
        hadoop.FileContext.getFileContext(self.path(name).toUri(), self._conf).rename(self.path(name), self.path(new), kinds)

    def created(self, name: str, said: str) -> bool:
        """Writes a file that must not be there yet, whole or not at all; False if there is one already.

        The content is stored under another name, then given this one by a rename that never replaces. The local file system's
        rename checks first, so there a hard link is made, which is one step.
        """
        own = self._stored(said)
        try:
            if self._fs.getScheme() == "file":
                local = lambda n: self.path(n).toUri().getPath()
                os.link(local(own), local(name))
            else:
                self._renamed(own, name, "NONE")
            return True
        except FileExistsError:
            return False
        except Py4JJavaError as error:
            if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
                return False
            raise
        finally:
            self.delete(own)

    def replace(self, name: str, said: str) -> None:
        """Writes a file in place of the one there; a reader sees the old content or the new."""
        self._renamed(self._stored(said), name, "OVERWRITE")

    def delete(self, name: str) -> None:
        self._fs.delete(self.path(name), True)

    def size(self, name: str) -> int:
        """Bytes under a folder."""
        return self._fs.getContentSummary(self.path(name)).getLength() if self._fs.exists(self.path(name)) else 0
