"""The engine: what a user of an index can do, each as a lazy DataFrame."""

from __future__ import annotations

import logging
from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import search, stats
from foliant.operators.index import Index
from foliant.sources import files as file_source
from foliant.streaming import incremental
from foliant.streaming.control import Control, Progress

log = logging.getLogger("foliant")


class Engine:
    """An index in a folder, and the directory of files that it covers."""

    def __init__(self, spark: SparkSession, path: str, root: str | None = None, stop_words: Iterable[str] | None = None, modern: bool = True, **options: float):
        """options: fan, term, patience of an Index."""
        self.spark, self.index_, self.root, self.modern = spark, Index(spark, path, stop_words, **options), root, modern

    def index(self, root: str | None = None) -> None:
        """Walk a directory and index what is new there. While another walk changes the index, IndexInUse is raised."""
        self.root = root or self.root
        self.index_.add_files(file_source.list_files(self.spark, self.root), incremental.loaded(self.root, self.modern))
        self.index_.compact_if_grown()
        if problems := sum(r.n_problems for r in self.index_.snapshot().runs):
            log.warning("%d files couldn't be read or seem to be binary: see problems()", problems)

    def index_stream(self, checkpoint: str, root: str | None = None, per_batch: int = 1000) -> bool:
        """The same as a stream that ends when all files there are indexed; it goes on from the checkpoint when called again. False if it was told to quit."""
        return incremental.finished(self.start_stream(checkpoint, root, per_batch))

    def start_stream(self, checkpoint: str, root: str | None = None, per_batch: int = 1000) -> StreamingQuery:
        """The same without waiting: the query has lastProgress, status and stop()."""
        self.root = root or self.root
        self.progress  # noqa: B018, from the first batch on
        return incremental.start_index(self.index_, self.root, checkpoint, per_batch, self.modern)

    def running(self) -> list[dict]:
        """Streams that are running: name, what they do now, and the last batch's figures, as a listener has them."""
        return [{"name": q.name, "message": q.status["message"], **(self.progress.of(q.name)[-1:] or [{}])[0]} for q in self.spark.streams.active]

    @cached_property
    def progress(self) -> Progress:
        """Figures of the session's streams from now on."""
        listener = Progress()
        self.spark.streams.addListener(listener)
        return listener

    def control(self, message: str) -> int:
        """Tell those who index into this index, in any application: pause, resume, save or quit; the message's number."""
        return Control(self.index_).send(message)

    def answered(self, number: int) -> dict | None:
        """What became of a message; None until it is read, between two batches."""
        return Control(self.index_).answer(number)

    def add(self, texts: DataFrame) -> None:
        self.index_.add(texts)

    def find(self, *globs: str) -> DataFrame:
        """file_id, name of files that have a word for every glob, in the order of file_id."""
        now = self.index_.snapshot()
        return search.find(now.postings_of(list(globs)), now.files, list(globs)).orderBy("file_id")

    def with_lines(self, found: DataFrame, *globs: str) -> DataFrame:
        """found (file_id, name) with lines, which are read from these files: no others are opened or listed."""
        at = found.select("file_id", "name", file_source.path_of(F.col("name"), self.root).alias("path"))
        loaded = file_source.texts(file_source.load_files(self.root, at), self.modern)
        return loaded.select("file_id", "name", search.matched_lines(F.col("raw"), list(globs)).alias("lines"))

    def find_lines(self, *globs: str, texts: DataFrame | None = None) -> DataFrame:
        """The same as find() with lines; texts (file_id, text) are read from the files anew if they aren't given."""
        if texts is None:
            return self.with_lines(self.find(*globs), *globs).orderBy("file_id")
        now = self.index_.snapshot()
        return search.find_with_lines(now.postings_of(list(globs)), now.files, texts, list(globs)).orderBy("file_id")

    def find_pages(self, *globs: str, size: int = 20, texts: DataFrame | None = None) -> search.Pager:
        """Pages of what find() finds, with lines. Results are kept in the index's folder, and only a page's files are opened."""

        def lines(some: DataFrame) -> DataFrame:
            if texts is None:
                return self.with_lines(some, *globs)
            rows = some.join(texts.select("file_id", "text"), "file_id", "left")
            return rows.select("file_id", "name", search.matched_lines(F.col("text"), list(globs)).alias("lines"))

        return search.Pager(self.find(*globs), size, f"{self.index_.path}/staging/results", lines)

    def find_files(self, glob: str) -> DataFrame:
        return search.find_files(self.index_.files, glob).orderBy("file_id")

    def pager(self, found: DataFrame, size: int = 20) -> search.Pager:
        return search.Pager(found, size)

    def file(self, file_id: int) -> DataFrame:
        return self.index_.files.where(F.col("file_id") == file_id)

    def files(self) -> DataFrame:
        return self.index_.files.orderBy("file_id")

    def words(self) -> DataFrame:
        return self.index_.words.orderBy("word")

    def word_ids(self) -> DataFrame:
        """word, word_id, count, df, in the order in which words came."""
        return self.index_.word_ids().orderBy("word_id")

    def postings(self, word: str) -> DataFrame:
        return self.index_.postings.where(F.col("word") == word)

    def delete(self, glob: str) -> None:
        self.index_.delete(search.find_files(self.index_.files, glob))

    def stats(self) -> DataFrame:
        now = self.index_.snapshot()
        return stats.index_stats(now.files, now.dictionary)

    def posting_stats(self, word: str) -> DataFrame:
        return stats.posting_stats(self.index_.postings, word)

    def terms(self, file_id: int) -> DataFrame:
        """word, tf of a file, from what it gave to the index: one row of the catalogue is read, and no postings."""
        return self.index_.terms_of(file_id).select("word", "tf")

    def inverted(self, file_id: int) -> DataFrame:
        """tf and the words that a file has so often."""
        return stats.inverted_frequencies(self.index_.terms_of(file_id)).select("tf", "words")

    def last_id(self) -> int:
        return self.index_.last_id()

    def problems(self) -> DataFrame:
        """name, message of files that couldn't be read or seem to be binary."""
        return self.index_.problems

    def write_stats(self) -> DataFrame:
        """What each batch wrote, and how long it took."""
        return self.index_.batches.orderBy("at")

    def unlock(self) -> None:
        self.index_.unlock()

    def save(self, path: str | None = None) -> Engine:
        """Compact the index in place, or write a compacted copy elsewhere; what was indexed is always saved already."""
        if path is None:
            self.index_.compact()
            return self
        return Engine(self.spark, self.index_.compact(path).path, self.root, self.index_.stop_words, self.modern)
