"""Versions of an index and leases on it: small JSON files whose numbers are taken by whoever writes one first.

A version is a manifest, written under the number after the one that its writer has read. If another writer took that number, put()
says so and the change is made again from what is there now, so no change is lost and none is seen in part. Readers hold the
manifest that they have read; what it names isn't changed by later versions.

A lease keeps others from beginning a change that would be lost: one that is held, and renewed in time by a thread of its holder, makes
claim() fail. It ends when its holder lets go or dies. A holder that was only slow finds that its number isn't the last any more and
gives up before it writes; should it write all the same, the number of its version is taken or makes the other begin again.

A name is taken by a link on a local disk, and by a rename without overwriting elsewhere, which is atomic on HDFS. This module is the only one
that uses Hadoop's file systems, through the session's JVM.
"""

from __future__ import annotations

import contextlib
import json
import os
import threading
import time
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class IndexInUse(RuntimeError):
    """Another walk, stream or compaction is changing the index."""


class Conflict(RuntimeError):
    """Another writer has made the next version."""


class Store:
    """Small files in a folder of any file system that Spark knows."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.system = self._path("").getFileSystem(self.conf)
        self.local = self.system.getUri().getScheme() == "file"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def _plain(self, name: str) -> str:
        return self._path(name).toUri().getPath()

    def names(self, folder: str = "") -> list[str]:
        """What the folder, or one below it, holds; nothing if it isn't there."""
        if self.local:
            with contextlib.suppress(FileNotFoundError):
                return os.listdir(self._plain(folder))
            return []
        where = self._path(folder)
        return [s.getPath().getName() for s in self.system.listStatus(where)] if self.system.exists(where) else []

    def read(self, name: str) -> str | None:
        """The text of a file; None if it isn't there."""
        where = self._path(name)
        try:
            stream = self.system.open(where)
        except Py4JJavaError as e:
            if "FileNotFound" in str(e.java_exception):
                return None
            raise
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """As a whole, in place of what is there."""
        if self.local:
            part = self._part(name, text)
            os.replace(part, self._plain(name))
            return
        out = self.system.create(self._path(name), True)
        out.write(bytearray(text.encode()))
        out.close()

    def _part(self, name: str, text: str) -> str:
        target = self._plain(name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        part = os.path.join(os.path.dirname(target), f".{uuid.uuid4().hex}")
        with open(part, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        return part

    def put(self, name: str, text: str) -> bool:
        """Write a file that isn't there yet, as a whole; False if it is."""
        if self.local:
            part = self._part(name, text)
            try:
                os.link(part, self._plain(name))
            except FileExistsError:
                return False
            finally:
                os.unlink(part)
            return True
        part = f"{name}.{uuid.uuid4().hex}"
        self.write(part, text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self.conf)
        none = self.jvm.java.lang.reflect.Array.newInstance(self.jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._path(part), self._path(name), none)
        except Py4JJavaError as e:
            self.system.delete(self._path(part), False)
            if "FileAlreadyExists" in str(e.java_exception):
                return False
            raise
        return True

    def remove(self, name: str = "") -> None:
        """A file or a folder with all it holds."""
        self.system.delete(self._path(name), True)

    def changed(self, name: str) -> float:
        """When a file or folder was last changed, in seconds."""
        return self.system.getFileStatus(self._path(name)).getModificationTime() / 1000


class Numbered:
    """Files PREFIX-NUMBER.json in a folder of a store."""

    def __init__(self, store: Store, folder: str, prefix: str):
        self.store, self.folder, self.prefix = store, folder, prefix

    def name(self, number: int) -> str:
        return f"{self.folder}/{self.prefix}-{number:012d}.json"

    def numbers(self) -> list[int]:
        start = f"{self.prefix}-"
        return sorted(int(n[len(start) : -5]) for n in self.store.names(self.folder) if n.startswith(start) and n.endswith(".json"))

    def read(self, number: int) -> dict | None:
        text = self.store.read(self.name(number))
        return None if text is None else json.loads(text)

    def last(self) -> tuple[int, dict | None]:
        """The largest number and what it holds; 0 and None if there are none."""
        while numbers := self.numbers():
            if (held := self.read(numbers[-1])) is not None:  # else it was just removed
                return numbers[-1], held
        return 0, None

    def put(self, number: int, held: dict) -> bool:
        return self.store.put(self.name(number), json.dumps(held))


class Leases:
    """Who may change the index now. The numbers of leases grow; only the last one counts."""

    def __init__(self, store: Store, term: float):
        self.files, self.term = Numbered(store, "leases", "l"), term

    def claim(self, patience: float = 0.0) -> Lease:
        """A lease, for which to wait so many seconds if another is held; then IndexInUse."""
        give_up = time.time() + patience
        while True:
            number, held = self.files.last()
            if held is None or held["done"] or held["until"] < time.time():
                mine = Lease(self, number + 1)
                if self.files.put(number + 1, mine.state(False)):
                    return mine
            elif time.time() >= give_up:
                raise IndexInUse(f"{self.files.store.folder} is being changed; a lease that nobody renews ends by itself, unlock() ends it now")
            time.sleep(min(0.2, self.term / 10))

    def end(self) -> None:
        """End the lease that is held, whoever has it."""
        number, held = self.files.last()
        if held:
            self.files.store.write(self.files.name(number), json.dumps({**held, "done": True}))


class Lease:
    def __init__(self, leases: Leases, number: int):
        self.leases, self.number, self.owner = leases, number, uuid.uuid4().hex
        self.over = threading.Event()

    def state(self, done: bool) -> dict:
        return {"owner": self.owner, "until": time.time() + self.leases.term, "done": done}

    def held(self) -> bool:
        """Whether nobody else has a later lease, and nobody ended this one."""
        number, held = self.leases.files.last()
        return number == self.number and held is not None and held["owner"] == self.owner and not held["done"]

    def _write(self, done: bool) -> None:
        self.leases.files.store.write(self.leases.files.name(self.number), json.dumps(self.state(done)))

    def _renew(self) -> None:
        while not self.over.wait(self.leases.term / 3):
            if not self.held():
                return
            self._write(False)

    @contextlib.contextmanager
    def kept(self) -> Iterator[Lease]:
        """Renewed by a thread until the block ends."""
        thread = threading.Thread(target=self._renew, daemon=True)
        thread.start()
        try:
            yield self
        finally:
            self.over.set()
            thread.join()
            if self.held():
                self._write(True)
                for old in self.leases.files.numbers()[:-2]:
                    self.leases.files.store.remove(self.leases.files.name(old))
