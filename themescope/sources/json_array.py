"""All results as one JSON array, indented by two: tasks write pieces of it, the commit joins them.

``spark.read.json`` reads it back with the option multiLine. At scale JSON Lines (``results.write_json``) are the better
form; an array is one file by nature. Paths are those of the file systems that pyarrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType, VariantType

from themescope.sources.xlsx import store_of


@dataclass
class Written(WriterCommitMessage):
    part: int
    path: str
    rows: int


class ArrayWriter(DataSourceArrowWriter):
    def __init__(self, path: str, texts: set[str]):
        self.path, self.texts = path, texts
        self.folder = f"{path.rstrip('/')}.pieces-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        context, rows = TaskContext.get(), 0
        store, folder = store_of(self.folder)
        store.create_dir(folder)
        name = f"{folder}/{context.partitionId()}-{context.taskAttemptId()}"
        with store.open_output_stream(name) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    told = {k: json.loads(v) if k in self.texts and v is not None else v for k, v in row.items()}
                    one = json.dumps(told, ensure_ascii=False, indent=2, default=str)
                    out.write(((",\n" if rows else "") + "\n".join("  " + line for line in one.split("\n"))).encode())
                    rows += 1
        return Written(context.partitionId(), name, rows)

    def commit(self, messages: list[Written | None]) -> None:
        store, target = store_of(self.path)
        made = f"{target}.{uuid.uuid4().hex}"
        pieces = [m for m in sorted((m for m in messages if m), key=lambda m: m.part) if m.rows]
        try:
            with store.open_output_stream(made) as out:
                out.write(b"[")
                for k, m in enumerate(pieces):
                    out.write(b",\n" if k else b"\n")
                    with store.open_input_stream(m.path) as piece:
                        while data := piece.read(1 << 20):
                            out.write(data)
                out.write(b"\n]" if pieces else b"]")
            store.move(made, target)
        finally:
            self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, folder = store_of(self.folder)
        if store.get_file_info(folder).type == fs.FileType.Directory:
            store.delete_dir(folder)


class JsonArray(DataSource):
    @classmethod
    def name(cls) -> str:
        return "json_array"

    def writer(self, schema: StructType, overwrite: bool) -> ArrayWriter:
        return ArrayWriter(self.options["path"], set(filter(None, self.options.get("texts", "").split("\n"))))


def write_json_array(results: DataFrame, path: str) -> None:
    """One file, an object for each row in the order of the partitions; variants become what they hold. Null fields are kept."""
    variants = [f.name for f in results.schema if isinstance(f.dataType, VariantType)]
    results.sparkSession.dataSource.register(JsonArray)
    told = results.withColumns({n: F.to_json(F.col(f"`{n}`")) for n in variants})
    told.write.format("json_array").option("texts", "\n".join(variants)).mode("overwrite").save(path)
