"""The index: runs of Parquet tables below a folder, and manifests that say which runs there are.

A run is what one change has written, in a folder of its own:

    files     seq, file_id, name, kind, token_count, error, terms, tfs     in the order of file_id; terms are the words that the file gave to the
                                                                           index, sorted, tfs how often each; without tfs, terms are all words
    postings  seq, since, word, block, count, df, ids, tfs            sorted by word; a row has the files of one block of ids
    deleted   seq, file_id                                            files that are gone from runs of smaller seq
    names     block, bits                                             a Bloom filter of names
    grams     gram, word                                              pieces of the run's words, sorted; runs that merges wrote have them

The columns word, count and df of postings are the dictionary, in part: readers add up the rows of all runs and read nothing of the
lists beside them. since is the seq with which a word came; merges keep the least. A run of deletions has rows with negative numbers, taken from the terms of what is deleted. Files that couldn't be
read have an error and no kind.

Runs have levels. A change writes a run of level 0; FAN runs of a level are merged into one of the next, so a posting is written again at
most once a level, a logarithm of the number of changes. Every change makes a version (see versions): a manifest with all runs,
the last id, and counters. A Snapshot reads one version. Runs that no version names any more stay for RETENTION seconds, so that
readers which have begun can end; what writers that died have left goes then, too.
"""

from __future__ import annotations

import logging
import time
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from copy import copy
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from functools import cached_property

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import lookup, members
from .stats import frequency_bags
from .tokens import counted, counted_apart, term_array
from .versions import Conflict, IndexInUse, Lease, Leases, Numbered, Store

log = logging.getLogger("foliant")
__all__ = ["Conflict", "Index", "IndexInUse", "Snapshot"]

FILES = "seq long, file_id long, name string, kind string, token_count long, error string, terms array<string>, tfs array<long>"
POSTINGS = "seq long, since long, word string, block long, count long, df long, ids array<long>, tfs array<long>"
DELETED = "seq long, file_id long"
BATCHES = "batch string, level int, n_files long, last_id long, n_postings long, n_tokens long, seconds double, at timestamp"
BLOCK = 1 << 16  # ids of a row of postings
TF_BITS = 40  # of a packed entry; a text has fewer words than 2 ** 31
FAN = 8  # runs of a level that are merged
ROW_GROUP = 16 << 20  # bytes; so small that a word's row groups are few
ROWS_A_FILE = 1_000_000  # of postings, each with up to BLOCK files
ENTRIES_A_TASK = 800_000  # entries of lists that a task sorts and gathers; its memory grows with them
WORDS_A_TASK = 250_000  # rows of the dictionary that a task adds up
BYTES_A_TASK = 16 << 20  # of texts that a task tokenizes
BYTES_A_SPLIT = 4 << 20  # of a run's tables that a task reads to make entries of them; a writer holds what it makes of these
BYTES_A_FILE = 1 << 16  # of a file whose length the list doesn't say
TERM = 60.0  # seconds of a lease that isn't renewed
RETENTION = 7 * 24 * 3600.0  # seconds that runs stay which no version names any more
STEPS = 100  # that are remembered
TRIES = 8  # times that a change is made anew because another version came first


@dataclass(frozen=True)
class Run:
    """What a manifest says of a run. seq is the version that it came with; batches is how many changes it holds."""

    id: str
    level: int
    seq: int
    n_rows: int = 0  # of files, with those that couldn't be read
    n_files: int = 0
    last_id: int = 0
    n_postings: int = 0
    n_tokens: int = 0
    n_deleted: int = 0
    n_problems: int = 0
    n_lists: int | None = None  # rows of postings; runs of earlier versions don't say
    filters: int = 0  # blocks of its Bloom filter
    grams: bool = False
    batches: int = 1
    seconds: float = 0.0
    at: float = 0.0


class Snapshot:
    """An index as one version has it."""

    def __init__(self, spark: SparkSession, path: str, version: int, manifest: dict | None):
        self.spark, self.path, self.version = spark, path, version
        manifest = manifest or {"runs": [], "retired": [], "last_id": 0, "written": 0, "rewritten": 0}
        self.retired = manifest["retired"]  # ids of runs of earlier versions, and since when they aren't named
        self.runs = [Run(**r) for r in manifest["runs"]]
        self.last_id, self.written, self.rewritten = manifest["last_id"], manifest["written"], manifest["rewritten"]

    def within(self, spark: SparkSession) -> Snapshot:
        """The same, read in another session."""
        other = copy(self)
        other.__dict__.pop("deleted", None)
        other.spark = spark
        return other

    def table(self, name: str, schema: str, runs: list[Run]) -> DataFrame:
        """One table of some runs."""
        if not runs:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/runs/{r.id}/{name}" for r in runs])

    @property
    def _with_files(self) -> list[Run]:
        return [r for r in self.runs if r.n_rows]

    @cached_property
    def deleted(self) -> DataFrame:
        """seq, file_id of deletions, as far as they still matter."""
        return self.table("deleted", DELETED, [r for r in self.runs if r.n_deleted])

    def live(self, rows: DataFrame) -> DataFrame:
        """Rows (seq, file_id) without those of files that were deleted after they were written."""
        if not any(r.n_deleted for r in self.runs):
            return rows
        gone = self.deleted.groupBy(F.col("file_id").alias("_gone")).agg(F.max("seq").alias("_until"))
        return rows.join(gone, (rows["file_id"] == gone["_gone"]) & (rows["seq"] < gone["_until"]), "left_anti")

    def rows(self, runs: list[Run] | None = None) -> DataFrame:
        """All of files, with errors and terms."""
        return self.live(self.table("files", FILES, self._with_files if runs is None else runs))

    @property
    def files(self) -> DataFrame:
        """file_id, name, kind, token_count."""
        return self.rows().where("error is null").select("file_id", "name", "kind", "token_count")

    @property
    def problems(self) -> DataFrame:
        """name, message of files that couldn't be read (they are tried again by the next walk) or seem to be binary."""
        message = F.coalesce("error", F.when(F.col("kind") == "ignore", "maybe binary file"))
        return self.rows().select("name", message.alias("message")).where("message is not null")

    def summed(self, *least: str) -> DataFrame:
        """word, the least of some columns, count, df of all runs. Rows are dealt by how many there are: shares of a session's partitions grow with them."""
        runs = [r for r in self.runs if r.n_rows or r.n_deleted]
        lists = self.table("postings", POSTINGS, runs).select("word", *least, "count", "df")
        dealt = lists.repartition(tasks(self.n_lists(runs), WORDS_A_TASK), "word")
        return dealt.groupBy("word").agg(*[F.min(c).alias(c) for c in least], F.sum("count").alias("count"), F.sum("df").alias("df")).where("df > 0")

    def n_lists(self, runs: list[Run]) -> int:
        """Rows of the dictionary."""
        unsaid = [r for r in runs if r.n_lists is None]
        return sum(r.n_lists or 0 for r in runs) + (self.table("postings", POSTINGS, unsaid).count() if unsaid else 0)

    def dictionary_rows(self, runs: list[Run] | None = None) -> DataFrame:
        """word, count, df in parts. Nothing of the lists is read."""
        return self.table("postings", POSTINGS, [r for r in (self.runs if runs is None else runs) if r.n_rows or r.n_deleted]).select("word", "count", "df")

    @property
    def dictionary(self) -> DataFrame:
        """word, count, df."""
        return self.summed()

    @property
    def words(self) -> DataFrame:
        """word, count, df, freq_bag."""
        return frequency_bags(self.dictionary)

    def word_ids(self) -> DataFrame:
        """word, word_id, count, df: words numbered from 1 in the order in which they came, those of one change by name. Later changes keep
        the numbers, unless words have gone with deleted files."""
        n = tasks(self.n_lists([r for r in self.runs if r.n_rows or r.n_deleted]), WORDS_A_TASK)
        return numbered(self.summed("since"), ["since", "word"], 0, f"{self.path}/staging/{uuid.uuid4().hex}", n).select("word", F.col("_id").alias("word_id"), "count", "df")

    def entries(self, runs: list[Run] | None = None) -> DataFrame:
        """seq, since, word, file_id, tf."""
        lists = self.table("postings", POSTINGS, self._with_files if runs is None else runs)
        return self.live(lists.select("seq", "since", "word", F.explode(F.arrays_zip("ids", "tfs")).alias("e")).select("seq", "since", "word", F.col("e.ids").alias("file_id"), F.col("e.tfs").alias("tf")))

    @property
    def postings(self) -> DataFrame:
        """word, file_id, tf of the files in the catalogue."""
        return self.entries().select("word", "file_id", "tf")

    def postings_of(self, globs: list[str]) -> DataFrame:
        """Postings of words that any glob matches. Words of globs without a fixed beginning are looked up first."""
        return self.postings.where(lookup.words_filter(self, globs))

    def terms_of(self, files: DataFrame | int) -> DataFrame:
        """file_id, word, tf of one file or of some (file_id): forward, from terms, so no postings are read."""
        rows = self.rows().where("error is null")
        return self.given(rows.where(F.col("file_id") == files) if isinstance(files, int) else rows.join(files.select("file_id"), "file_id", "left_semi"))

    @staticmethod
    def given(rows: DataFrame) -> DataFrame:
        """file_id, word, tf of rows of files."""
        given = F.when(F.col("tfs").isNull(), counted(F.col("terms"))).otherwise(F.arrays_zip(F.col("terms").alias("word"), F.col("tfs").alias("tf")))
        return rows.select("file_id", given.alias("given")).select("file_id", F.inline("given"))

    @property
    def batches(self) -> DataFrame:
        """What was written: batch, level, n_files, last_id, n_postings, n_tokens, seconds, at; as many rows as there are runs with files."""
        rows = [(r.id, r.level, r.n_files, r.last_id, r.n_postings, r.n_tokens, r.seconds, datetime.fromtimestamp(r.at, UTC)) for r in self._with_files if r.n_files]
        return self.spark.createDataFrame(rows, BATCHES)


def tasks(n: int | None, a_task: int | None = None) -> int:
    """How many tasks share n entries or bytes, so that one's memory doesn't depend on how much there is."""
    return max(1, -(-int(n or 0) // (a_task or ENTRIES_A_TASK)))


def kept(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(file_id: Column, tf: Column) -> Column:
    """An entry of a block's list as one number, in the order of file_id: numbers are gathered and sorted without a row for each."""
    return file_id.bitwiseAND(F.lit(BLOCK - 1)) * F.lit(1 << TF_BITS) + tf


def file_id_of(block: Column, e: Column) -> Column:
    return block * F.lit(BLOCK) + F.shiftright(e, TF_BITS)


def tf_of(e: Column) -> Column:
    return e.bitwiseAND(F.lit((1 << TF_BITS) - 1))


def numbered(rows: DataFrame, order: list[str], last_id: int, path: str, n: int | None = None) -> DataFrame:
    """rows with _id: their place in a range sort after last_id, from the number of rows in the ranges before. n: ranges, else the session's."""
    ranged = rows.repartitionByRange(*([n] if n else []), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # of a row in its range, from 0: the bits above are the range's
    held = kept(ranged.withColumn("part", F.spark_partition_id()).withColumn("rank", place + 1), path)
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = held.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("before"))
    ranked = held.join(F.broadcast(before), "part")
    return ranked.select(*rows.columns, (F.col("rank") + F.col("before") + F.lit(last_id)).cast("long").alias("_id"))


class Index:
    """An index in a folder. Its tables are those of the last version; snapshot() holds one."""

    def __init__(self, spark: SparkSession, path: str, stop_words: Iterable[str] | None = None, fan: int = FAN, term: float = TERM, patience: float = 0.0):
        """fan: runs that are merged; term: seconds of a lease; patience: how long a change waits for another one."""
        self.spark, self.path, self.fan, self.patience = spark, path.rstrip("/"), fan, patience
        self.stop_words = None if stop_words is None else tuple(stop_words)
        self.store = Store(spark, self.path)
        self.versions = Numbered(self.store, "versions", "v")
        self.leases = Leases(self.store, term)
        self.steps: deque[dict] = deque(maxlen=STEPS)  # what the changes made here have done: step, seconds, figures

    # What there is.

    def snapshot(self, version: int | None = None) -> Snapshot:
        """The last version, or an earlier one, as long as it is kept."""
        if version is None:
            return Snapshot(self.spark, self.path, *self.versions.last())
        manifest = self.versions.read(version)
        if manifest is None:
            raise KeyError(f"version {version} of {self.path} isn't kept")
        return Snapshot(self.spark, self.path, version, manifest)

    def __getattr__(self, name: str):
        if name in ("files", "postings", "words", "dictionary", "problems", "batches", "deleted", "entries", "postings_of", "terms_of", "word_ids"):
            return getattr(self.snapshot(), name)
        raise AttributeError(name)

    def last_id(self) -> int:
        return self.snapshot().last_id

    @cached_property
    def writer(self) -> SparkSession:
        """The session in which runs are read to write runs of them: the caller's, but for two settings that this one mustn't share.

        A scan's task is made of up to 128 MB of files otherwise, and what it makes of them is some sixteen times as much, which the writer of a
        shuffle holds. A task's lists are gathered in a hash table, unless it has more than WORDS_A_TASK of them: 128 is when an aggregate
        falls back to sorting otherwise, and entries of one word, equal in what they are sorted by, are slow to sort.
        """
        own = self.spark.newSession()
        for key, value in self.spark.conf.getAll.items():
            if own.conf.isModifiable(key):
                own.conf.set(key, value)
        own.conf.set("spark.sql.files.maxPartitionBytes", str(BYTES_A_SPLIT))
        own.conf.set("spark.sql.files.openCostInBytes", str(BYTES_A_SPLIT // 8))
        own.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", str(WORDS_A_TASK))
        return own

    # Changes.

    @contextmanager
    def locked(self) -> Iterator[Lease]:
        """Refuse others that change the index, in this or another application, until the block ends."""
        with self.leases.claim(self.patience).kept() as lease:
            yield lease

    def unlock(self) -> None:
        """End a lease now that would end by itself, as its holder has died."""
        self.leases.end()

    def clear(self) -> None:
        """Start anew: remove all there is."""
        self.store.remove()

    def _change(self, make: Callable[[Snapshot, str], tuple[list[Run], set[str], int] | None]) -> Snapshot:
        """Make the next version. make gets the last one and a new run's id, writes the run, and gives the runs to add (seq is the
        next version), the ids of those that go, and the last id; or None if nothing changes. It is called again if another version came first."""
        with self.locked() as lease:
            for _ in range(TRIES):
                before = self.snapshot()
                made = make(before, uuid.uuid4().hex)
                if made is None:
                    return before
                new, gone, last_id = made
                rows = sum(r.n_postings for r in new)
                merged = rows if gone else 0
                now = time.time()
                manifest = {
                    "retired": [[i, at] for i, at in before.retired if at >= now - RETENTION] + [[i, now] for i in sorted(gone)],
                    "runs": [asdict(r) for r in [*(r for r in before.runs if r.id not in gone), *new]],
                    "last_id": max(last_id, before.last_id),
                    "written": before.written + rows - merged,
                    "rewritten": before.rewritten + merged,
                    "lease": lease.number,
                    "at": now,
                }
                if not lease.held():
                    raise IndexInUse(f"{self.path} was taken over by another change; this one isn't made")
                if self.versions.put(before.version + 1, manifest):
                    return Snapshot(self.spark, self.path, before.version + 1, manifest)
            raise Conflict(f"{self.path} changes too often")

    def add(self, texts: DataFrame) -> None:
        """Index texts: name, kind, text, and perhaps file_id. Names already indexed are passed over, ignored files get no words.

        What is new is settled on names alone. Then the texts are joined with their ids. Ids without file_id go on from the last one, in
        the order of names.
        """
        given = "file_id" in texts.columns
        named = texts.where("name is not null")

        def rows(ids: DataFrame, named: DataFrame, every: bool, n: int) -> DataFrame:
            if given and every:  # each row is a new name's only one, and has its id
                found = named.withColumn("_id", F.col("file_id").cast("long"))
            else:
                found = named.join(ids.select("name", "_id"), "name")
                if ids.where("copies > 1").head(1):  # one text of a name counts
                    found = (found.where("file_id = _id") if given else found).dropDuplicates(["name"])
            found = found.select(F.col("_id").alias("file_id"), "name", "kind", "text", F.lit(None).cast("string").alias("error"))
            return found.repartitionByRange(n, "file_id").sortWithinPartitions("file_id")

        self._add(named, given, F.octet_length("text"), rows, False)

    def add_files(self, listed: DataFrame, load: Callable[[DataFrame], DataFrame]) -> None:
        """Index listed files (name and what load needs). load gets those that are new and gives name, kind, text, error for each.

        So only new files are opened. One with an error isn't indexed but becomes a problem.
        """

        def rows(ids: DataFrame, listed: DataFrame, every: bool, n: int) -> DataFrame:
            one = listed.dropDuplicates(["name"]) if ids.where("copies > 1").head(1) else listed
            found = one.join(ids.select("name", F.col("_id").alias("file_id")), "name").repartitionByRange(n, "file_id").sortWithinPartitions("file_id")
            return load(found).select("file_id", "name", "kind", "text", "error")

        self._add(listed, False, F.col("length") if "length" in listed.columns else F.lit(BYTES_A_FILE), rows, True)

    def _add(self, named: DataFrame, given: bool, size: Column, texts: Callable[[DataFrame, DataFrame, bool, int], DataFrame], keep: bool) -> None:
        """texts makes rows, in the order of file_id, of the ids of new names, named, whether each row of named is a new name's only one, and
        the number of tasks; size: bytes of a row of named; keep: named is costly to make and small, so it is staged."""
        staging = f"staging/{uuid.uuid4().hex}"
        if keep:
            with self._step("list"):
                named = kept(named, f"{self.path}/{staging}/listed")

        def make(before: Snapshot, run: str) -> tuple | None:
            began, here, seq = time.time(), f"{self.path}/{staging}/{run}", before.version + 1
            found = named.groupBy("name").agg(F.count(F.lit(1)).alias("copies"), F.sum(size).alias("bytes"), *([F.min("file_id").cast("long").alias("_id")] if given else []))
            with self._step("new names") as step:
                names, all_new = members.unknown(before, found, here)
                ids = kept(names if given else numbered(names, ["name"], before.last_id, f"{here}/names"), f"{here}/ids")
                n_names, last, copies, n_bytes = ids.agg(F.count(F.lit(1)), F.max("_id"), F.max("copies"), F.sum("bytes")).first()
                step["names"] = n_names
            if not n_names:
                return None
            every, n = copies == 1 and all_new, tasks(n_bytes, BYTES_A_TASK)
            read = F.when(F.col("kind").isNotNull() & (F.col("kind") != "ignore"), F.col("text"))
            rows = texts(ids, named, every, n).select("file_id", "name", "kind", "error", term_array(read, self.stop_words).alias("terms"))
            rows = rows.select("file_id", "name", "kind", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("token_count"), "error", "terms")
            rows = counted_apart(rows, "terms").select(F.lit(seq).cast("long").alias("seq"), "file_id", "name", "kind", "token_count", "error", "terms", "tfs")
            seen = Observation()
            observed = rows.observe(seen, F.count_if(F.expr("error is null")).alias("n_files"), F.max(F.expr("if(error is null, file_id, null)")).alias("last_id"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr("error is not null or kind = 'ignore'")).alias("n_problems"), F.sum(F.expr("if(error is null, greatest(size(terms), 0), 0)")).alias("n_terms"))
            with self._step("load and tokenize") as step:
                self._write(observed, f"{run}/files")
                got = seen.get
                step["files"] = got["n_files"]
            with self._step("postings") as step:
                counts = self._write_postings(self._counted(run), got["n_terms"], seq, f"{run}/postings")
                step |= counts
            with self._step("filter of names"):
                blocks = members.write_filter(ids.select("name"), n_names, f"{self.path}/runs/{run}/names")
            made = Run(run, 0, seq, n_rows=got["n_rows"], n_files=got["n_files"], n_problems=got["n_problems"], last_id=got["last_id"] or 0, filters=blocks, seconds=round(time.time() - began, 3), at=time.time(), **counts)
            return [made], set(), last or 0

        self._change(make)
        self.store.remove(staging)

    @contextmanager
    def _step(self, name: str, **figures: int) -> Iterator[dict]:
        """Remember and log how long a step took; the block may add figures."""
        step, began = {"step": name, "at": time.time(), **figures}, time.time()
        self.steps.append(step)
        yield step
        step["seconds"] = round(time.time() - began, 3)
        log.info("%s: %s", self.path, step)

    def _write(self, df: DataFrame, path: str) -> None:
        df.write.option("parquet.block.size", ROW_GROUP).option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{self.path}/runs/{path}")

    def _counted(self, run: str) -> DataFrame:
        """file_id, word, tf of a run that is being written."""
        files = self.writer.read.schema(FILES).parquet(f"{self.path}/runs/{run}/files").where("error is null")
        return files.select("file_id", "tfs", F.posexplode("terms").alias("at", "word")).select("file_id", "word", F.get("tfs", F.col("at")).alias("tf"))

    def _write_postings(self, entries: DataFrame, n: int | None, seq: int, path: str) -> dict[str, int]:
        """From (file_id, word, tf), n at most: one shuffle, by ranges of word and block of ids, in which lists are made."""
        ranged = entries.select("word", (F.shiftright("file_id", 16)).alias("block"), packed(F.col("file_id"), F.col("tf")).alias("e")).repartitionByRange(tasks(n), "word", "block")
        held = ranged.groupBy("word", "block").agg(F.sum(tf_of(F.col("e"))).alias("tokens"), F.sort_array(F.collect_list("e")).alias("held"))
        lists = held.select(F.lit(seq).cast("long").alias("since"), "word", "block", F.col("tokens").alias("count"), F.size("held").cast("long").alias("df"), "tokens", "held")
        return self._write_lists(lists, seq, path)

    def _write_lists(self, held: DataFrame, seq: int, path: str) -> dict[str, int]:
        """Rows since, word, block, count, df, tokens, held (packed, sorted), dealt by ranges of word; what was written is counted meanwhile."""
        seen = Observation()
        held = held.observe(seen, F.coalesce(F.sum(F.size("held")), F.lit(0)).alias("n_postings"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_lists"))
        ids, tfs = F.transform("held", lambda e: file_id_of(F.col("block"), e)), F.transform("held", tf_of)
        lists = held.sortWithinPartitions("word", "block").select(F.lit(seq).cast("long").alias("seq"), "since", "word", "block", "count", "df", ids.alias("ids"), tfs.alias("tfs"))
        self._write(lists, path)
        got = seen.get
        return {name: int(got[name]) for name in ("n_postings", "n_tokens", "n_lists")}

    def delete(self, gone: DataFrame) -> None:
        """Delete files (file_id). Their names may be indexed again. What their terms added to the dictionary is taken off in a run of its own."""

        def make(before: Snapshot, run: str) -> tuple | None:
            began, seq = time.time(), before.version + 1
            ids = gone.select(F.col("file_id").cast("long").alias("file_id")).join(before.files.select("file_id"), "file_id", "left_semi").distinct()
            self._write(ids.select(F.lit(seq).cast("long").alias("seq"), "file_id"), f"{run}/deleted")
            ids = self.writer.read.schema(DELETED).parquet(f"{self.path}/runs/{run}/deleted").select("file_id")
            n = ids.count()
            if not n:
                return None
            less = before.within(self.writer).terms_of(ids).groupBy("word").agg((-F.sum("tf")).alias("count"), (-F.count(F.lit(1))).alias("df"))
            none = F.array().cast("array<long>")
            rows = less.select(F.lit(seq).cast("long").alias("seq"), F.lit(seq).cast("long").alias("since"), "word", F.lit(None).cast("long").alias("block"), "count", "df", none.alias("ids"), none.alias("tfs"))
            seen = Observation()
            self._write(rows.repartitionByRange("word").observe(seen, F.count(F.lit(1)).alias("n_lists")).sortWithinPartitions("word"), f"{run}/postings")
            return [Run(run, 0, seq, n_deleted=n, n_lists=seen.get["n_lists"], seconds=round(time.time() - began, 3), at=time.time())], set(), 0

        self._change(make)

    # Merging.

    def compact_if_grown(self) -> None:
        """Merge the runs of each level that has FAN of them; the merged run is of the next level."""
        while True:
            levels: dict[int, list[Run]] = {}
            for r in self.snapshot().runs:
                levels.setdefault(r.level, []).append(r)
            full = [level for level, runs in sorted(levels.items()) if len(runs) >= self.fan]
            if not full:
                return
            with self._step("merge", level=full[0]):
                self._change(lambda before, run, level=full[0]: self._merge(before, [r for r in before.runs if r.level == level], run, level + 1))
            self.vacuum()

    def compact(self, to: str | None = None) -> Index:
        """Merge all runs into one, without deleted files: in place, or in another folder."""
        if to is None:
            self._change(lambda before, run: self._merge(before, before.runs, run, max((r.level for r in before.runs), default=0) + 1) if before.runs else None)
            self.vacuum()
            return self
        new = Index(self.spark, to, self.stop_words, self.fan, self.leases.term)
        from_ = self.snapshot()
        new._change(lambda before, run: (*new._merge(from_, from_.runs, run, 1, before.version + 1)[:2], from_.last_id))
        return new

    def _merge(self, before: Snapshot, runs: list[Run], run: str, level: int, seq: int | None = None) -> tuple[list[Run], set[str], int]:
        """Write runs as one. Counts of the dictionary are added up as they are, unless all runs are merged: then those of files that are gone go."""
        began, seq, before = time.time(), seq or before.version + 1, before.within(self.writer)
        whole = len(runs) == len(before.runs)
        with_files = [r for r in runs if r.n_rows]
        n_rows = tasks(max(sum(r.n_tokens for r in with_files), sum(r.n_rows for r in with_files)))
        files = before.rows(with_files).withColumn("seq", F.lit(seq).cast("long")).repartitionByRange(n_rows, "file_id")
        seen = Observation()  # after the shuffle, as ranges are found by reading what comes before twice
        observed = files.observe(seen, F.count_if(F.expr("error is null")).alias("n_files"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.expr("error is not null or kind = 'ignore'")).alias("n_problems"))
        self._write(observed.sortWithinPartitions("file_id"), f"{run}/files")
        entries = before.entries(with_files).select("since", "word", F.shiftright("file_id", 16).alias("block"), (F.col("tf") if whole else F.lit(0).cast("long")).alias("count"), F.lit(int(whole)).cast("long").alias("df"), packed(F.col("file_id"), F.col("tf")).alias("e"))
        if not whole:
            if any(r.n_deleted for r in before.runs):  # entries of files that are left, from these, so that only files are joined with what is deleted
                left = Snapshot.given(self.writer.read.schema(FILES).parquet(f"{self.path}/runs/{run}/files").where("error is null"))
                none = F.lit(0).cast("long")  # the dictionary's rows say since when there is a word
                entries = left.select(F.lit(None).cast("long").alias("since"), "word", F.shiftright("file_id", 16).alias("block"), none.alias("count"), none.alias("df"), packed(F.col("file_id"), F.col("tf")).alias("e"))
            counts = before.table("postings", POSTINGS, [r for r in runs if r.n_rows or r.n_deleted]).select("since", "word", "block", "count", "df", F.lit(None).cast("long").alias("e"))
            entries = entries.union(counts)
        ranged = entries.repartitionByRange(tasks(sum(r.n_postings for r in with_files)), "word", "block")
        held = ranged.groupBy("word", "block").agg(F.min("since").alias("since"), F.sum("count").alias("count"), F.sum("df").alias("df"), F.sum(tf_of(F.col("e"))).alias("tokens"), F.sort_array(F.collect_list("e")).alias("held")).where("count <> 0 or df <> 0 or size(held) > 0")
        counts = self._write_lists(held, seq, f"{run}/postings")
        n_deleted = 0
        if not whole:
            gone = before.table("deleted", DELETED, [r for r in runs if r.n_deleted])
            met = before.table("files", FILES, with_files).select(F.col("file_id").alias("_met"), F.col("seq").alias("_of"))
            left = gone.join(met, (gone["file_id"] == met["_met"]) & (met["_of"] < gone["seq"]), "left_anti")  # what it deletes is in other runs
            self._write(left, f"{run}/deleted")
            n_deleted = self.writer.read.schema(DELETED).parquet(f"{self.path}/runs/{run}/deleted").count()
        got = seen.get
        staging = f"staging/{uuid.uuid4().hex}"
        words = self.writer.read.schema(POSTINGS).parquet(f"{self.path}/runs/{run}/postings").select("word").repartition(tasks(counts["n_lists"], WORDS_A_TASK), "word").distinct()
        lookup.write_grams(words, f"{self.path}/runs/{run}/grams", ROW_GROUP, f"{self.path}/{staging}")
        self.store.remove(staging)
        names = self.writer.read.schema(FILES).parquet(f"{self.path}/runs/{run}/files").where("error is null").select("name")
        blocks = members.write_filter(names, got["n_files"], f"{self.path}/runs/{run}/names")
        batches = sum(r.batches for r in runs)
        last = max((r.last_id for r in with_files), default=0)
        made = Run(run, level, seq, n_rows=got["n_rows"], n_files=got["n_files"], n_problems=got["n_problems"], last_id=last, n_deleted=n_deleted, filters=blocks, grams=True, batches=batches, seconds=round(time.time() - began, 3), at=time.time(), **counts)
        return [made], {r.id for r in runs}, before.last_id

    def vacuum(self, retention: float = RETENTION) -> None:
        """Remove versions but the last that are older than so many seconds, and runs and staged tables that no version has named for as long."""
        old, last = time.time() - retention, self.snapshot()
        for number in self.versions.numbers():
            manifest = self.versions.read(number)
            if number >= last.version or (manifest and manifest["at"] >= old):
                break  # later ones aren't older
            self.store.remove(self.versions.name(number))
        keep = {r.id for r in last.runs} | {i for i, at in last.retired if at >= old}
        for folder, named in (("runs", keep), ("staging", set())):
            for name in self.store.names(folder):
                if name not in named and self.store.changed(f"{folder}/{name}") <= old:
                    self.store.remove(f"{folder}/{name}")
