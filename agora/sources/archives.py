"""Zip archives as tables: their directories first, then ranged reads of the entries that are wanted.

A directory is read from an archive's end, without its entries; it is a table like any other, to be filtered and joined. Entries are
then dealt out over tasks by their places, whatever archive they are in, and each is read and inflated by itself: what is not
wanted is never decoded, and an archive may be larger than any value or task.
"""

from __future__ import annotations

import codecs
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import pandas as pd
from pyarrow import fs
from pyspark import Accumulator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a task inflates, about; bytes that are inflated at a time.
TASK, CHUNK = 32 << 20, 1 << 20
#: Fixed values of the format: a local header, its length, the two methods known here.
_LOCAL, _HEADER, STORED, DEFLATED = b"PK\x03\x04", 30, 0, 8
ENTRY = "archive string, position long, name string, at long, compressed long, size long, method int, crc long"


def opened(path: str):
    """A file in any file system that Arrow knows, open for reads at any place."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote(path.removeprefix("file:").replace("///", "/", 1)))
    files, place = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return files.open_input_file(place)


def paths(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(archive): the files under a path, a folder or a pattern; no content is read."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("archive"))


def directory(archives: DataFrame) -> DataFrame:
    """ENTRY: a row for each file in the archives (archive), by its position in the directory. Folders are left out, an encrypted
    entry or another method than deflate raises."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["archive"]:
                with opened(path) as f, zipfile.ZipFile(f) as z:
                    found = [i for i in z.infolist() if not i.is_dir()]
                if odd := [i.filename for i in found if i.flag_bits & 1 or i.compress_type not in (STORED, DEFLATED)]:
                    raise ValueError(f"{path} holds {odd[0]}, which can't be read here")
                yield pd.DataFrame([(path, n, i.filename, i.header_offset, i.compress_size, i.file_size, i.compress_type, i.CRC) for n, i in enumerate(found)], columns=[c.split()[0] for c in ENTRY.split(", ")])

    return archives.repartition(archives.sparkSession.sparkContext.defaultParallelism, "archive").mapInPandas(run, ENTRY)


def inflated(f, at: int, compressed: int, method: int, crc: int) -> Iterator[bytes]:
    """An entry's bytes, piece by piece; a sum that does not agree raises."""
    f.seek(at)
    head = f.read(_HEADER)
    if head[:4] != _LOCAL:
        raise ValueError("no entry begins here")
    f.seek(at + _HEADER + sum(struct.unpack("<HH", head[26:30])))
    unpack, seen = zlib.decompressobj(-15) if method == DEFLATED else None, 0
    while compressed:
        raw = f.read(min(CHUNK, compressed))
        if not raw:
            raise ValueError("the archive ends within an entry")
        compressed -= len(raw)
        out = unpack.decompress(raw) if unpack else raw
        seen = zlib.crc32(out, seen)
        yield out
    if unpack:
        out = unpack.flush()
        seen = zlib.crc32(out, seen)
        yield out
    if seen != crc:
        raise ValueError("an entry is damaged")


def entries(wanted: DataFrame, schema: str, rows: Callable[[dict, Iterator[bytes]], Iterator[tuple]], decoded: Accumulator | None = None) -> DataFrame:
    """What rows makes of each entry of wanted (columns of ENTRY and any others) and its bytes; a row of schema at a time.

    decoded, an accumulator, counts the entries that are read."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, part in frame.groupby("archive", sort=False):
                with opened(path) as f:
                    for e in part.sort_values("at").to_dict("records"):
                        if decoded is not None:
                            decoded.add(1)
                        out, held = [], 0
                        for r in rows(e, inflated(f, int(e["at"]), int(e["compressed"]), int(e["method"]), int(e["crc"]))):
                            out.append(r)
                            held += sum(len(x) for x in r if isinstance(x, str))
                            if held > CHUNK:
                                yield pd.DataFrame(out, columns=names)
                                out, held = [], 0
                        if out:
                            yield pd.DataFrame(out, columns=names)

    total = wanted.agg(F.sum("size"), F.count("*")).first()
    tasks = max(1, min(total[1], max(wanted.sparkSession.sparkContext.defaultParallelism, -(-(total[0] or 0) // TASK))))
    return wanted.repartition(tasks, "archive", "at").mapInPandas(run, schema)


def texts(wanted: DataFrame, keep: list[str], decoded: Accumulator | None = None) -> DataFrame:
    """The columns keep of wanted, with value: each entry's bytes as UTF-8."""
    kinds = dict(wanted.dtypes)
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "value string"])
    return entries(wanted, schema, lambda e, data: iter([(*(e[c] for c in keep), b"".join(data).decode())]), decoded)


def elements(data: Iterator[bytes]) -> Iterator[str]:
    """The elements of a JSON array, each in JSON, or a lone value; no more than an element and a piece are held."""
    decode, more, text, at, ended = json.JSONDecoder().raw_decode, codecs.getincrementaldecoder("utf-8-sig")(), "", 0, False
    blank = " \t\r\n"

    def grow(least: int = 1) -> None:
        nonlocal text, at, ended
        parts, n = [text[at:]], 0
        while n < least and not ended:
            if (piece := next(data, None)) is None:
                parts.append(more.decode(b"", True))
                ended = True
            else:
                parts.append(more.decode(piece))
                n += len(parts[-1])
        text, at = "".join(parts), 0

    def seek() -> str:
        """The next letter that is not blank; "" at the end."""
        nonlocal at
        while True:
            while at < len(text) and text[at] in blank:
                at += 1
            if at < len(text) or ended:
                return text[at : at + 1]
            grow()

    array = seek() == "["
    at += array
    while (c := seek()) and not (array and c == "]"):
        while True:
            try:
                value, end = decode(text, at)
                if ended or text[end : end + 1] in (*blank, ",", "]"):  # else a number may go on in the next piece
                    break
            except ValueError:
                if ended:
                    raise
            grow(len(text) - at)  # at least as much again, so that a large element is tried few times
        at = end
        yield json.dumps(value)
        if array and seek() == ",":
            at += 1
        elif array and seek() != "]":
            raise ValueError("an array does not go on after an element")
    if array and not c:
        raise ValueError("an array does not end")


def json_rows(wanted: DataFrame, decoded: Accumulator | None = None) -> DataFrame:
    """(archive, name, value): each element of the JSON array that an entry holds, or its one value."""
    return entries(wanted, "archive string, name string, value string", lambda e, data: ((e["archive"], e["name"], x) for x in elements(data)), decoded)
