"""Incremental reading of a registry's pages and version histories.

``registry_pages`` walks search results: its offset is the next page token of each
query, so a restarted stream goes on behind the last committed page. ``registry_history``
walks a list of record ids: its offset is a place in the list; a task fetches a record's
version list and each version's body. Both read stored responses through ``responses_of``,
paced by ``pacing``; a client of a live service is another such function.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition, SimpleDataSourceStreamReader

from asofly.sources.pacing import Answer, Pace, fetch


def responses_of(folder: str) -> Callable[[str], Answer]:
    """Answers from stored files: ``NAME.json``, or ``NAME.N.json`` holding {status, retry_after, body} for attempt N before it."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    asked: dict[str, int] = {}

    def get(name: str) -> Answer:
        asked[name] = asked.get(name, 0) + 1
        refusal = f"{root}/{name}.{asked[name]}.json"
        if store.get_file_info([refusal])[0].type == fs.FileType.File:
            with store.open_input_file(refusal) as f:
                stored = json.loads(f.read())
            return Answer(stored["status"], stored.get("body", ""), stored.get("retry_after"))
        if store.get_file_info([f"{root}/{name}.json"])[0].type != fs.FileType.File:
            return Answer(404)
        with store.open_input_file(f"{root}/{name}.json") as f:
            return Answer(200, f.read().decode())

    return get


class _Client:
    """Paced requests one after another."""

    def __init__(self, options: dict):
        self.get = responses_of(options["path"])
        self.pace, self.last = Pace(interval=float(options.get("interval", "1.05")), floor=float(options.get("floor", "2.0"))), float("-inf")

    def body(self, name: str) -> str:
        text, self.pace, self.last = fetch(lambda: self.get(name), self.pace, time.monotonic, time.sleep, self.last)
        return text


FIRST, DONE = "first", ""


class PageReader(SimpleDataSourceStreamReader):
    """One page of each open query at a time: a service that limits the rate is asked from one place."""

    def __init__(self, options: dict):
        self.client = _Client(options)
        self.queries = [q for q in options.get("queries", "").split(",") if q]
        self.field, self.token = options.get("records", "studies"), options.get("token", "nextPageToken")

    def initialOffset(self) -> dict:  # noqa: N802
        return dict.fromkeys(self.queries, FIRST)

    def _page(self, query: str, page: str) -> tuple[list[tuple], str]:
        answer = json.loads(self.client.body(f"{query}/{page}"))
        return [(query, page, json.dumps(x, ensure_ascii=False)) for x in answer.get(self.field) or []], answer.get(self.token) or DONE

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        rows, end = [], dict(start)
        for query in self.queries:
            if (page := start.get(query, FIRST)) != DONE:
                found, end[query] = self._page(query, page)
                rows += found
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        """The same pages again, for a batch that was begun before a restart."""
        for query in self.queries:
            page, stop = start.get(query, FIRST), end.get(query, FIRST)
            while page not in (stop, DONE):
                found, page = self._page(query, page)
                yield from found

    def commit(self, end: dict) -> None:
        pass


class RegistryPages(DataSource):
    """``readStream.format("registry_pages")``: (query, page, body); options path, queries, records, token, interval, floor."""

    @classmethod
    def name(cls) -> str:
        return "registry_pages"

    def schema(self) -> str:
        return "query string, page string, body string"

    def simpleStreamReader(self, schema) -> PageReader:  # noqa: N802
        return PageReader(self.options)


class Record(InputPartition):
    pass


class HistoryReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.ids = [x for x in options.get("ids", "").split(",") if x]
        self.step, self.at = int(options.get("records_per_batch", "100")), 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.at = min(self.at + self.step, len(self.ids))
        return {"at": self.at}

    def partitions(self, start: dict, end: dict) -> list[Record]:
        self.at = max(self.at, end["at"])
        return [Record(x) for x in self.ids[start["at"] : end["at"]]]

    def read(self, partition: Record) -> Iterator[tuple]:
        client = _Client(self.options)
        for entry in json.loads(client.body(f"{partition.value}/history"))["changes"]:
            number = int(entry["version"])
            yield partition.value, number, str(entry.get("date") or ""), client.body(f"{partition.value}/history/{number}")


class RegistryHistory(DataSource):
    """``readStream.format("registry_history")``: (id, version, posted, body) of every version of the records listed in ``ids``."""

    @classmethod
    def name(cls) -> str:
        return "registry_history"

    def schema(self) -> str:
        return "id string, version int, posted string, body string"

    def streamReader(self, schema) -> HistoryReader:  # noqa: N802
        return HistoryReader(self.options)
