"""Record connectors as a Python data source that replays stored responses.

There is no network here: a connector is a folder of paged JSON responses. The
source walks pages by their tokens as the service would, in one partition for each
query, since the services limit the rate.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Query(InputPartition):
    pass


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.queries = [q for q in options.get("queries", "").split(",") if q]
        self.most = int(options.get("max_records", "0"))
        self.field = options.get("records", "studies")
        self.token = options.get("token", "nextPageToken")

    def partitions(self) -> list[Query]:
        return [Query(q) for q in self.queries]

    def read(self, partition: Query) -> Iterator[tuple]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(self.folder)
        page, n, seen = "first", 0, set()
        while page and page not in seen:
            seen.add(page)
            with store.open_input_file(f"{root}/{partition.value}/{page}.json") as f:
                answer = json.loads(f.read())
            for record in answer.get(self.field) or []:
                if self.most and n >= self.most:
                    return
                n += 1
                yield partition.value, page, json.dumps(record, ensure_ascii=False)
            page = answer.get(self.token)


class ReplaySource(DataSource):
    """``format("registry_replay")``: (query, page, body) of every record; the option ``max_records`` ends a query early."""

    @classmethod
    def name(cls) -> str:
        return "registry_replay"

    def schema(self) -> str:
        return "query string, page string, body string"

    def reader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)
