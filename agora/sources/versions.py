"""Tables of files whose current version a manifest names: a write is seen as a whole or not at all.

Tasks write files that nothing names yet, and tell the driver of them; commit writes the next manifest, abort deletes the files. What a
lost task has written is named by no manifest. Two writers that start from one version can't both commit. Paths may be in any file
system that Arrow knows.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

_WIDTH = 9


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def _manifest(files: fs.FileSystem, root: str, version: int) -> str:
    return f"{root}/manifests/{version:0{_WIDTH}d}.json"


def version(path: str) -> int:
    """The number of the current version; 0 where nothing was committed."""
    files, root = _place(path)
    found = files.get_file_info(fs.FileSelector(f"{root}/manifests", allow_not_found=True))
    return max((int(f.base_name[:_WIDTH]) for f in found if f.base_name[:_WIDTH].isdigit() and f.base_name.endswith(".json")), default=0)


def held(path: str, at: int | None = None) -> list[str]:
    """The files of a version, of the current one if none is given."""
    files, root = _place(path)
    at = version(path) if at is None else at
    if not at:
        return []
    with files.open_input_stream(_manifest(files, root, at)) as f:
        return json.loads(f.read())["files"]


def read(spark: SparkSession, path: str, schema: str, at: int | None = None) -> DataFrame:
    """The table under path, empty where nothing was committed."""
    names = held(path, at)
    return spark.read.schema(schema).parquet(*(f"{path}/data/{n}" for n in names)) if names else spark.createDataFrame([], schema)


def clear(path: str, keep: int = 1) -> int:
    """Delete files that none of the last keep versions names, what lost tasks left among them; how many. No write may be under way."""
    files, root = _place(path)
    now = version(path)
    named = {n for v in range(max(1, now - keep + 1), now + 1) for n in held(path, v)}
    lost = [f.path for f in files.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)) if f.base_name not in named]
    for p in lost:
        files.delete_file(p)
    for v in range(1, max(1, now - keep + 1)):
        if files.get_file_info(_manifest(files, root, v)).type == fs.FileType.File:
            files.delete_file(_manifest(files, root, v))
    return len(lost)


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class Versioned(DataSource):
    """df.write.format("versioned").mode("overwrite").option("path", p).save(): df as the next version. mode("append") keeps the
    files of the version before as well. Option base names the version that the rows were made from; another one fails."""

    @classmethod
    def name(cls) -> str:
        return "versioned"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.base = int(options["base"]) if "base" in options else version(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> _Written:
        files, root = _place(self.path)
        out, name = None, f"{uuid.uuid4().hex}.parquet"
        for batch in batches:
            if batch.num_rows:
                if out is None:
                    files.create_dir(f"{root}/data", recursive=True)
                    out = pq.ParquetWriter(f"{root}/data/{name}", batch.schema, filesystem=files)
                out.write_batch(batch)
        if out is not None:
            out.close()
        return _Written(None if out is None else name)

    def commit(self, messages: list[_Written | None]) -> None:
        files, root = _place(self.path)
        if version(self.path) != self.base:
            self.abort(messages)
            raise RuntimeError(f"another write has taken the place of version {self.base}")
        names = ([] if self.overwrite else held(self.path, self.base)) + [m.name for m in messages if m and m.name]
        files.create_dir(f"{root}/manifests", recursive=True)
        started = f"{root}/manifests/started-{uuid.uuid4().hex}"
        with files.open_output_stream(started) as f:
            f.write(json.dumps({"files": names}).encode())
        files.move(started, _manifest(files, root, self.base + 1))

    def abort(self, messages: list[_Written | None]) -> None:
        files, root = _place(self.path)
        for m in messages:
            if m and m.name:
                files.delete_file(f"{root}/data/{m.name}")
