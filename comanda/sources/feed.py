"""The cursor-paged HTTP feed as a Spark data source, in batch and as a stream.

A page is asked for with ``cursor`` (the last stream_id seen) and ``limit``; the feed answers with a
JSON array of events in ascending stream_id. A short or empty page ends the feed. A stream's offset is
the cursor, which Spark keeps in its checkpoint, so a restarted query asks for what it has not seen.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator
from urllib.parse import urlencode
from urllib.request import urlopen

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Fixed values of the feed: rows a page at most, tries, seconds between them, seconds between pages.
MOST_ROWS, TRIES, RETRY_WAIT, PAGE_WAIT, TIMEOUT = 500, 3, 5.0, 1.0, 60


class Feed:
    """Pages of one feed; ``options`` has url, and may have limit, max_records, retry_wait and page_wait."""

    def __init__(self, options: dict):
        self.url = options["url"]
        self.limit = min(int(options.get("limit", MOST_ROWS)), MOST_ROWS)
        self.most = int(options.get("max_records", 0))
        self.retry_wait, self.page_wait = float(options.get("retry_wait", RETRY_WAIT)), float(options.get("page_wait", PAGE_WAIT))

    def page(self, cursor: int) -> list[dict]:
        asked = f"{self.url}?{urlencode({'cursor': cursor, 'limit': self.limit})}"
        for left in reversed(range(TRIES)):
            try:
                with urlopen(asked, timeout=TIMEOUT) as answer:
                    return json.load(answer)
            except OSError:
                if not left:
                    raise
                time.sleep(self.retry_wait)
        return []

    def rows(self, cursor: int) -> Iterator[tuple[int, str]]:
        """(stream_id, payload) after the cursor to the end of the feed, or ``max_records`` of them."""
        n = 0
        while True:
            page = self.page(cursor)
            for event in page:
                yield int(event["stream_id"]), json.dumps(event)
                n += 1
                if self.most and n >= self.most:
                    return
            if len(page) < self.limit:
                return
            cursor = int(page[-1]["stream_id"])
            time.sleep(self.page_wait)


class FeedReader(DataSourceReader):
    """One partition: each page's cursor is known only from the page before."""

    def __init__(self, options: dict):
        self.feed, self.start = Feed(options), int(options.get("start", 0))

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(self.start)]

    def read(self, partition: InputPartition) -> Iterator[tuple[int, str]]:
        yield from self.feed.rows(partition.value)


class FeedStreamReader(SimpleDataSourceStreamReader):
    """A micro-batch is one page."""

    def __init__(self, options: dict):
        self.feed, self.start = Feed(options), int(options.get("start", 0))

    def initialOffset(self) -> dict:
        return {"cursor": self.start}

    def read(self, start: dict) -> tuple[Iterator[tuple[int, str]], dict]:
        rows = [(int(e["stream_id"]), json.dumps(e)) for e in self.feed.page(start["cursor"])]
        return iter(rows), {"cursor": rows[-1][0] if rows else start["cursor"]}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple[int, str]]:
        for row in self.feed.rows(start["cursor"]):
            if row[0] > end["cursor"]:
                return
            yield row


class CursorFeed(DataSource):
    """``spark.read.format("cursor_feed").option("url", ...)``: stream_id, payload."""

    @classmethod
    def name(cls) -> str:
        return "cursor_feed"

    def schema(self) -> str:
        return "stream_id long, payload string"

    def reader(self, schema) -> FeedReader:
        return FeedReader(self.options)

    def simpleStreamReader(self, schema) -> FeedStreamReader:
        return FeedStreamReader(self.options)
