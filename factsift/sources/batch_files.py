"""One CSV file a batch, named ``<name>_result_<k>.csv`` (K1), as a Spark data source.

``df.write.format("result_batches")`` writes them: each task writes the batches
it holds to a hidden folder, and when all tasks have ended the commit moves every
file to its name, in place of an older file of the batch. A job that fails moves
nothing; one whose driver dies in the commit leaves whole files only. The rows
must come with each batch whole in a task and in order, as ``write_batch_files``
deals them. ``sources.results.read_result_folder`` reads such folders.
"""

from __future__ import annotations

import csv
import io
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from factsift import constants as K
from factsift.session import ship_package
from factsift.sources.files import qualified

FORMAT = "result_batches"


@dataclass
class Written(WriterCommitMessage):
    """The batches a task has written and where."""

    folder: str
    names: list[str]


class BatchFileWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, columns: list[str]):
        self.uri, self.name, self.null = options["path"], options["name"], options.get("nullvalue", "\\N")
        self.columns = [c for c in columns if c != "batch_id"]
        self.staging = f"{self.uri}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = pafs.FileSystem.from_uri(f"{self.staging}/{uuid.uuid4().hex}")  # an attempt's own
        fs.create_dir(folder, recursive=True)
        names, batch, out, text = [], None, None, None
        for record in iterator:
            ids = record.column(record.schema.get_field_index("batch_id")).to_pylist()
            columns = [record.column(record.schema.get_field_index(c)).to_pylist() for c in self.columns]
            for k, *row in zip(ids, *columns):
                if k != batch:
                    if out is not None:
                        text.flush()
                        text.close()
                    batch = k
                    names.append(K.RESULT_FILE_NAME.format(name=self.name, batch=k))
                    out = fs.open_output_stream(f"{folder}/{names[-1]}", compression=None)
                    text = io.TextIOWrapper(out, encoding="utf-8", newline="")
                    rows = csv.writer(text)
                    rows.writerow(self.columns)
                rows.writerow([self.null if v is None else v for v in row])
        if out is not None:
            text.flush()
            text.close()
        return Written(folder, names)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = pafs.FileSystem.from_uri(self.uri)
        for message in messages:
            for name in message.names if message else ():
                final = f"{folder}/{name}"
                if fs.get_file_info(final).type != pafs.FileType.NotFound:
                    fs.delete_file(final)
                fs.move(f"{message.folder}/{name}", final)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        fs, staging = pafs.FileSystem.from_uri(self.staging)
        if fs.get_file_info(staging).type != pafs.FileType.NotFound:
            fs.delete_dir(staging)


class BatchFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema, overwrite: bool) -> BatchFileWriter:
        return BatchFileWriter(dict(self.options), schema.fieldNames())


def write_batch_files(df: DataFrame, path: str, name: str, order: str | None = "seq") -> None:
    """K1: the rows of ``df`` as one CSV file per ``batch_id`` below ``path``.

    All columns but ``batch_id`` and ``order`` are written, in order of ``order``;
    batches that ``df`` doesn't hold are left as they are.
    """
    spark = df.sparkSession
    ship_package(spark)
    spark.dataSource.register(BatchFiles)
    by = ["batch_id", *([order] if order and order in df.columns else [])]
    dealt = df.repartition("batch_id").sortWithinPartitions(*by)
    (dealt.drop(*by[1:]).write.format(FORMAT).option("name", name).mode("append").save(qualified(spark, path)))
