"""A feed as a stream: a changed body is a batch of one row, an unchanged one is none.

The offset is the body's fingerprint alone, so a restart resumes from Spark's checkpoint. A body is written to the state
folder before its offset is given out, so a batch that is had again reads what it read at first, whatever the
feed holds by then. The feed is asked with the etag and the time of the last answer.
``feeds.map_records`` and ``feeds.map_entries`` make rows of the bodies.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from tallyline.sources import feeds, shared

_LATEST = "latest.json"


class FeedReader(DataSourceStreamReader):
    def __init__(self, fetch: Callable[..., feeds.Fetched], options: Mapping[str, str]):
        missing = [n for n in ("url", "state") if not options.get(n)]
        if missing:
            raise feeds.SourceError(f"a feed needs the options {', '.join(missing)}")
        self.fetch, self.url, self.state = fetch, options["url"], options["state"].rstrip("/")
        self.limits = {"max_bytes": int(options["max_bytes"])} if options.get("max_bytes") else {}

    def _body(self, fingerprint: str) -> str:
        return f"{self.state}/{fingerprint}.body"

    def _held(self) -> dict[str, str]:
        """The last answer; nothing if its body is gone."""
        latest = f"{self.state}/{_LATEST}"
        held = json.loads(shared.read_whole(latest)) if shared.exists(latest) else {}
        return held if held and shared.exists(self._body(held["fingerprint"])) else {}

    def initialOffset(self) -> dict[str, str]:
        return {"fingerprint": ""}

    def latestOffset(self) -> dict[str, str]:
        """Asks the feed. A body that is no UTF-8 raises SourceError before any batch depends on it."""
        held = self._held()
        got = self.fetch(self.url, etag=held.get("etag"), last_modified=held.get("last_modified"), **self.limits)
        if got.unchanged:
            if not held:
                raise feeds.SourceError(f"{self.url} says that it hasn't changed, but no body of it is held")
            return {"fingerprint": held["fingerprint"]}
        try:
            got.body.decode("utf-8-sig")
        except UnicodeDecodeError as e:
            raise feeds.SourceError(f"{self.url} isn't UTF-8: {e}") from None
        found = feeds.fingerprint(got.body)
        if not shared.exists(self._body(found)):
            shared.write_whole(self._body(found), got.body)
        shared.write_whole(f"{self.state}/{_LATEST}", json.dumps({"fingerprint": found, "etag": got.etag, "last_modified": got.last_modified}).encode())
        return {"fingerprint": found}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        return [InputPartition(end["fingerprint"])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield self.url, partition.value, shared.read_whole(self._body(partition.value)).decode("utf-8-sig")

    def commit(self, end: dict) -> None:
        """Bodies other than the committed one and the last answer's belong to no batch that can come again."""
        keep = {f"{end['fingerprint']}.body", f"{self._held().get('fingerprint')}.body"}
        for name in shared.names(self.state):
            if name.endswith(".body") and name not in keep:
                shared.remove(f"{self.state}/{name}")


class FeedSource(DataSource):
    """Format ``tallyline_feed``, for streams: url, fingerprint and the body as value. Options: url, state (a folder of this stream alone that the cluster shares), max_bytes."""

    fetch = staticmethod(feeds.fetch)

    @classmethod
    def name(cls) -> str:
        return "tallyline_feed"

    def schema(self) -> str:
        return "url string, fingerprint string, value string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return FeedReader(type(self).fetch, self.options)


def read_stream(spark: SparkSession, url: str, state: str, source: type[FeedSource] = FeedSource, **options: str) -> DataFrame:
    """The feed's bodies as a stream; source: a class with another way to fetch, as tests have."""
    spark.dataSource.register(source)
    return spark.readStream.format(source.name()).options(url=url, state=state, **options).load()
