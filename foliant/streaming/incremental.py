"""Indexing as a stream: micro-batches of new files are appended to an index."""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import search
from foliant.operators.index import Index
from foliant.sources import files as file_source
from foliant.streaming.control import Control, Stopped


def loaded(root: str, modern: bool = True):
    """From listed files to name, kind, text, error, with the other columns of the list; for Index.add_files()."""

    def load(listed: DataFrame) -> DataFrame:
        return file_source.texts(file_source.load_files(root, listed), modern)

    return load


def queued(index: Index, root: str, checkpoint: str, per_batch: int) -> DataFrame:
    """What a walk finds and the index doesn't have, written beside the checkpoint in files of per_batch names, as a stream of these files.

    The walk is that of a batch, in tasks, so both find the same files; the queue limits what a micro-batch opens. Names that an
    earlier walk queued and no batch has taken yet may be queued twice, and are indexed once.
    """
    where = f"{checkpoint}/queue"
    found = search.new_files(file_source.list_files(index.spark, root), index.files)
    found.repartitionByRange("name").sortWithinPartitions("name").write.mode("append").option("maxRecordsPerFile", per_batch).parquet(where)
    return index.spark.readStream.schema(file_source.LISTED).option("maxFilesPerTrigger", 1).parquet(where)


def start_index(index: Index, root: str, checkpoint: str, per_batch: int = 1000, modern: bool = True) -> StreamingQuery:
    """Begin to index all files below root that the index doesn't have. One stream a checkpoint.

    The stream carries names; each batch opens those of its files that aren't in the index, so a batch that runs twice adds nothing
    twice. The query that is returned tells its progress; messages (see control) hold it or end it between batches.
    """

    control = Control(index)

    def merge(batch: DataFrame, number: int) -> None:
        control.between(number)
        index.add_files(batch, loaded(root, modern))
        index.compact_if_grown()

    stream = queued(index, root, checkpoint, per_batch)
    return stream.writeStream.queryName(f"index of {root}").foreachBatch(merge).option("checkpointLocation", f"{checkpoint}/progress").trigger(availableNow=True).start()


def finished(query: StreamingQuery) -> bool:
    """Wait for a stream's end: whether it did all there was, and wasn't told to quit before."""
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if Stopped.__name__ not in str(e):
            raise
        return False
    return True


def index_rows(index: Index, source: DataFrame, checkpoint: str) -> None:
    """The same for a stream of rows that act as files: file_id, name, kind, text."""
    source.writeStream.foreachBatch(lambda batch, _: index.add(batch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def document_stream(spark: SparkSession, path: str, files_per_batch: int = 4) -> DataFrame:
    """A table of documents (doc_id, text), a folder of Parquet files, as a stream of its files."""
    schema = spark.read.parquet(path).schema
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return found.selectExpr("doc_id as file_id", "format_string('doc/%d.txt', doc_id) as name", "'text' as kind", "coalesce(text, '') as text")
