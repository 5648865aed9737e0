"""Paginated REST lists as a Spark data source: each start address is a partition, read on executors with retries.

The client is a function from address to JSON. Sources take it by import name, "package.module:factory", and call the factory with
their options: tests answer from recorded pages, and nothing here opens a connection by itself. A list that follows its pages is also
a stream: its offset is the next address of each list, so that a query that stops goes on at the page it had come to.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Callable, Iterator
from urllib.parse import parse_qsl, urlencode, urlsplit, urlunsplit

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Answers after which a request is tried again.
RETRIED = (429, 500, 502, 503, 504)
TRIES, BACKOFF = 5, 1.5
#: Pages of a list that a batch of a stream takes at most.
MOST = 256


class Failed(Exception):
    def __init__(self, status: int):
        super().__init__(f"status {status}")
        self.status = status


def with_parameter(url: str, name: str, value: object) -> str:
    """url with one query parameter added, or replaced where it stands; of a name that is there twice the last value stays."""
    p = urlsplit(url)
    query = dict(parse_qsl(p.query, keep_blank_values=True)) | {name: str(value)}
    return urlunsplit(p._replace(query=urlencode(query)))


def request(url: str, get: Callable[[str], dict], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep) -> dict:
    """get(url), tried again after network errors and the answers of RETRIED; an envelope whose status is not OK raises."""
    for attempt in range(tries):
        try:
            answer = get(url)
            break
        except (OSError, Failed) as e:
            if attempt + 1 == tries or isinstance(e, Failed) and e.status not in RETRIED:
                raise
            sleep(BACKOFF**attempt)
    if isinstance(answer, dict) and answer.get("status", "OK") not in ("OK", 200):
        raise Failed(0)
    return answer


def pages(url: str, get: Callable[[str], dict], items: str, **how) -> Iterator[dict]:
    """Items of a list and of the pages that follow it; a page seen before ends the walk."""
    seen: set[str] = set()
    while url and url not in seen:
        seen.add(url)
        answer = request(url, get, **how)
        yield from answer.get(items) or []
        url = (answer.get("pagination") or {}).get("next")


def recorded(path: str) -> Callable[[str], dict]:
    """A client that answers from a JSON file of {address: answer}."""
    with open(path) as f:
        held = json.load(f)

    def get(url: str) -> dict:
        if url not in held:
            raise Failed(404)
        return held[url]

    return get


def recorded_client(options: dict[str, str]) -> Callable[[str], dict]:
    return recorded(options["recorded"])


def address_key(url: str) -> str:
    return hashlib.sha1(url.encode()).hexdigest()


def folder_client(options: dict[str, str]) -> Callable[[str], dict]:
    """A client that answers from the folder of option pages, in any file system that Arrow knows: a file under key=address_key(url)
    for each address, as Spark's partitioned text writer leaves them."""
    from pyarrow import fs

    place = options["pages"]
    files, root = fs.FileSystem.from_uri(place) if ":" in place else (fs.LocalFileSystem(), place)

    def get(url: str) -> dict:
        found = files.get_file_info(fs.FileSelector(f"{root}/key={address_key(url)}", allow_not_found=True))
        held = sorted(f.path for f in found if f.base_name.startswith("part-"))
        if not held:
            raise Failed(404)
        with files.open_input_stream(held[0]) as f:
            return json.loads(f.read())

    return get


def client(options: dict[str, str]) -> Callable[[str], dict]:
    """What the factory named by option client makes of the options; without a name answers come from option recorded."""
    module, _, name = options.get("client", "agora.sources.rest:recorded_client").partition(":")
    return getattr(importlib.import_module(module), name)(options)


class _Start(InputPartition):
    def __init__(self, url: str):
        self.url = url


class RestLists(DataSource):
    """spark.read or spark.readStream .format("rest_lists").option("urls", "u1 u2").option("items", "bills").option("client", name).load()

    Rows (url, item): the start of a list, and an item in JSON. Reading at once, each list is a partition, walked on an executor. A
    stream takes a page of each list for its first batch, then as many as it has taken before, up to MOST; a page seen before ends
    its list. Run it by processingTime, as rows come with the pages: availableNow would take one batch."""

    @classmethod
    def name(cls) -> str:
        return "rest_lists"

    def schema(self) -> str:
        return "url string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def simpleStreamReader(self, schema) -> SimpleDataSourceStreamReader:  # noqa: N802  the interface's name
        return _Pages(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.options = dict(options)

    def partitions(self):
        return [_Start(u) for u in self.options["urls"].split()]

    def read(self, partition: _Start):
        get = client(self.options)
        for item in pages(partition.url, get, self.options.get("items", "items"), sleep=lambda s: None):
            yield partition.url, json.dumps(item, sort_keys=True)


class _Pages(SimpleDataSourceStreamReader):
    """An offset has, for each list, the next address ("" at its end) and the keys of the pages before it."""

    def __init__(self, options):
        self.options = dict(options)

    def initialOffset(self) -> dict:  # noqa: N802
        return {u: {"next": u, "seen": []} for u in self.options["urls"].split()}

    def read(self, start: dict) -> tuple[Iterator[tuple[str, str]], dict]:
        get, rows, after = client(self.options), [], {}
        for url, at in start.items():
            following, seen, before = at["next"], list(at["seen"]), set(at["seen"])
            for _ in range(min(MOST, max(1, len(seen)))):
                if not following:
                    break
                answer = request(following, get)
                rows += [(url, json.dumps(item, sort_keys=True)) for item in answer.get(self.options.get("items", "items")) or []]
                seen.append(address_key(following))
                before.add(seen[-1])
                following = (answer.get("pagination") or {}).get("next") or ""
                following = "" if following and address_key(following) in before else following
            after[url] = {"next": following, "seen": seen}
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[str, str]]:  # noqa: N802
        """The pages from start on, read again up to end: what a batch had that must be made once more."""
        while start != end:
            rows, after = self.read(start)
            if after == start:
                return
            yield from rows
            start = after

    def commit(self, end: dict) -> None:
        pass
