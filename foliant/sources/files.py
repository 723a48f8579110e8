"""Directories of files.

list_files() walks a directory in tasks: the driver opens folders until there are enough of them to share out, and each task
walks the trees below its own; a folder with many entries is shared out in slices. Only names and sizes are read, so ignored and already
indexed files are never opened. load_files() reads the contents of the files that are left, in tasks too.

Every regular file counts, also one without bytes and one whose name starts with a dot or an underscore; links aren't
followed. What can't be listed or read has a message in the column error in place of a size or content.

A root without a scheme is local; others (file:, hdfs:, s3: and so on) are opened by pyarrow.
"""

from __future__ import annotations

import os
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.classify import file_kind, is_ignored_name, lossy_text
from foliant.functions.html import html_to_text

LISTED = "name string, path string, length long, error string"
SHARES = 4  # folders a core that the driver opens for
BRIEF = 1000  # entries of a folder that the driver reads
HELD = 16 << 20  # bytes of contents in an Arrow batch, unless one file has more

Entry = tuple[str, bool, int | None, str | None]  # path, whether it is a folder, size, error


def located(root: str) -> tuple[fs.FileSystem, str]:
    """What opens the files below root, and the path there."""
    scheme, sep, rest = root.partition(":")
    if not sep or "/" in scheme:
        return fs.LocalFileSystem(), os.path.abspath(root)
    return fs.FileSystem.from_uri(f"{scheme}://{rest}" if not rest.startswith("//") else root)


def entries(store: fs.FileSystem, folder: str, part: int = 0, parts: int = 1) -> Iterator[Entry]:
    """What a folder holds, or one of so many slices of it: folders and regular files; an error in place of a folder that can't be opened."""
    mine = (lambda name: zlib.crc32(os.fsencode(name)) % parts == part) if parts > 1 else (lambda name: True)
    try:
        if isinstance(store, fs.LocalFileSystem):
            with os.scandir(folder) as found:
                for e in found:
                    if not mine(e.name):
                        continue
                    try:
                        if e.is_dir(follow_symlinks=False):
                            yield e.path, True, None, None
                        elif e.is_file(follow_symlinks=False):
                            yield e.path, False, e.stat(follow_symlinks=False).st_size, None
                    except OSError as problem:
                        yield e.path, False, None, str(problem)
        else:
            for e in store.get_file_info(fs.FileSelector(folder)):  # pyarrow has no way to read a listing in parts
                if e.type in (fs.FileType.Directory, fs.FileType.File) and mine(e.base_name):
                    yield e.path, e.type == fs.FileType.Directory, e.size, None
    except OSError as problem:
        if part == 0:
            yield folder, False, None, str(problem)


def walked(store: fs.FileSystem, folder: str, part: int = 0, parts: int = 1) -> Iterator[Entry]:
    """The files of a folder and of all below it; or of a slice of its entries and of all below them."""
    todo = [(folder, part, parts)]
    while todo:
        for e in entries(store, *todo.pop()):
            if e[1]:
                todo.append((e[0], 0, 1))
            else:
                yield e


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """name (the path below the root), path, length, error of all regular files below root that the name filter lets through.

    A folder in which the driver has seen BRIEF entries isn't read on: tasks get it in slices by a hash of names, and each reads the
    folder but looks only at the files, and walks only the folders, of its own slice. So the driver never holds more than BRIEF
    entries of each of the few folders that it opens.
    """
    store, top = located(root)
    cores = spark.sparkContext.defaultParallelism
    shares = SHARES * cores
    todo, items = [top], []  # items: path, length, error, is_file, slice, slices
    opened = 0
    while todo and len(todo) + len(items) < shares and opened < shares:  # breadth first
        folder = todo.pop(0)
        opened += 1
        found = list(islice(entries(store, folder), BRIEF))
        if len(found) < BRIEF:
            todo += [e[0] for e in found if e[1]]
            items += [(e[0], e[2], e[3], True, 0, 1) for e in found if not e[1]]
        else:
            items += [(folder, None, None, False, i, 2 * cores) for i in range(2 * cores)]
    items += [(p, None, None, False, 0, 1) for p in todo]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, _ = located(root)
        for batch in batches:
            for path, length, error, is_file, part, parts in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                rows = []
                for e in [(path, False, length, error)] if is_file else walked(at, path, part, parts):
                    rows.append((posixpath.relpath(e[0], top), *e[:1], *e[2:]))
                    if len(rows) == 4096:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    dealt = spark.createDataFrame(items, "path string, length long, error string, is_file boolean, part int, parts int")
    return dealt.repartition(max(1, min(len(items), shares))).mapInArrow(walk, LISTED).where(~is_ignored_name(F.col("name")))


def path_of(name: Column, root: str) -> Column:
    """Where a file of this name (its path below the root) is."""
    return F.concat(F.lit(located(root)[1].rstrip("/") + "/"), name)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
    return pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["name", "path", "length", "error"])


def load_files(root: str, listed: DataFrame) -> DataFrame:
    """The columns of listed (among them path) and content: the bytes, or null where error says why there are none.

    listed may have an error already, and then isn't opened. A file is read whole; batches are cut by bytes.
    """
    rows = listed if "error" in listed.columns else listed.withColumn("error", F.lit(None).cast("string"))
    kept = [c for c in rows.columns if c not in ("error", "content")]
    rows = rows.select(*kept, "error")
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("error", T.StringType()), T.StructField("content", T.BinaryType())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = located(root)
        for batch in batches:
            start, held, errors, contents = 0, 0, [], []
            paths = batch.column(batch.schema.get_field_index("path")).to_pylist()

            def made(end: int, start: int, errors: list, contents: list) -> pa.RecordBatch:
                part = batch.slice(start, end - start)  # noqa: B023
                return pa.record_batch([*part.columns[:-1], pa.array(errors, pa.string()), pa.array(contents, pa.binary())], names=[*kept, "error", "content"])

            for i, (path, error) in enumerate(zip(paths, batch.column(batch.num_columns - 1).to_pylist(), strict=True)):
                data = None
                if error is None:
                    try:
                        with store.open_input_stream(path, compression=None) as f:
                            data = f.read()
                    except OSError as problem:
                        error = str(problem)
                errors.append(error)
                contents.append(data)
                held += len(data or b"")
                if held >= HELD:
                    yield made(i + 1, start, errors, contents)
                    start, held, errors, contents = i + 1, 0, [], []
            if contents:
                yield made(batch.num_rows, start, errors, contents)

    return rows.mapInArrow(read, schema)


def texts(loaded: DataFrame, modern: bool = True) -> DataFrame:
    """Of loaded files, with their other columns: kind (html, text or ignore), text (null if ignored), raw; all null of what couldn't be read."""
    known = loaded.withColumn("kind", F.when(F.col("content").isNotNull(), file_kind(F.col("name"), F.col("content"))))
    raw = lossy_text(F.col("content"))
    text = F.when(F.col("kind") == "html", html_to_text(raw, modern)).when(F.col("kind") == "text", raw)
    return known.withColumn("text", text).withColumn("raw", F.when(F.col("kind") != "ignore", raw)).drop("content")


def write_files(named: DataFrame, root: str) -> None:
    """Write rows of name, content as files below root. Names are unique; a file that is there is replaced as a whole."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = located(root)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = posixpath.join(top, name)
                store.create_dir(posixpath.dirname(path), recursive=True)
                part = f"{path}.{uuid.uuid4().hex}"
                with store.open_output_stream(part, compression=None) as out:
                    out.write(content.as_buffer())
                store.move(part, path)
        yield from ()

    named.select("name", "content").mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()
