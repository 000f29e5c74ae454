"""A sink that posts rows to an HTTP endpoint in batches (S33), for tables and streams.

spark.dataSource.register(PostSink); df.write.format("millrace_post").mode("append").options(url=..., sent=<shared folder>).save()

Each task sorts out its rows into batches of JSON, posts them with a key that follows from their content, and retries by the ladder of X05. A batch
that the endpoint took is noted in the folder ``sent`` under its key, and is not posted again by a task that runs once more, or by a write that is
repeated; rows should come in a defined order within partitions for that (``posted`` sees to it). The key also goes along as Idempotency-Key. If a
task fails for good the write aborts: batches that went out stay noted, the others were never posted.
"""

from __future__ import annotations

import hashlib
import importlib
import json
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, DataSourceWriter, WriterCommitMessage

from millrace.sources.watch import _store

BATCH = 100
#: First delay and number of retries.
FIRST_DELAY_S, RETRIES = 0.5, 3


def http_post(url: str, body: bytes, headers: dict) -> int:
    """One request; its status."""
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, data=body, headers=headers, method="POST"), timeout=30) as answer:
            return answer.status
    except HTTPError as e:
        return e.code


class NotTaken(RuntimeError):
    """The endpoint refused a batch, or did not answer in any try."""


@dataclass
class Posted(WriterCommitMessage):
    batches: int
    repeated: int
    rows: int


def _plain(value):
    return value.isoformat() if hasattr(value, "isoformat") else {k: _plain(v) for k, v in value.asDict().items()} if hasattr(value, "asDict") else value


class _Poster:
    """What the writers of tables and of streams have in common. It runs in tasks."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.size, self.root = int(options.get("batch", BATCH)), options.get("root", "data")
        self.delay, self.retries = float(options.get("first_delay_s", FIRST_DELAY_S)), int(options.get("retries", RETRIES))

    def _post(self, body: bytes, key: str) -> None:
        module, _, name = self.options.get("opener", f"{__name__}:http_post").partition(":")
        send = getattr(importlib.import_module(module), name)
        headers = {"Content-Type": "application/json", "Idempotency-Key": key, **json.loads(self.options.get("headers", "{}"))}
        for n in range(self.retries + 1):
            try:
                status = send(self.options["url"], body, headers)
            except OSError as e:
                status = str(e)
            if isinstance(status, int) and 200 <= status < 300:
                return
            # Other refusals would come again.
            if isinstance(status, int) and status < 500 and status not in (408, 429):
                break
            if n < self.retries:
                time.sleep(self.delay * 2**n)
        raise NotTaken(f"{self.options['url']}: {status}")

    def write(self, rows: Iterator) -> Posted:
        store, folder = _store(self.options["sent"])
        store.create_dir(folder, recursive=True)
        done, batch = Posted(0, 0, 0), []

        def flush() -> None:
            if not batch:
                return
            body = json.dumps({self.root: batch}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
            key = hashlib.sha256(body).hexdigest()
            mark = f"{folder.rstrip('/')}/{key}"
            if store.get_file_info(mark).type.name == "NotFound":
                self._post(body, key)
                with store.open_output_stream(mark):
                    pass
                done.batches += 1
            else:
                done.repeated += 1
            done.rows += len(batch)
            batch.clear()

        for row in rows:
            batch.append({k: _plain(v) for k, v in row.asDict().items()})
            if len(batch) >= self.size:
                flush()
        flush()
        return done


class PostWriter(_Poster, DataSourceWriter):
    def commit(self, messages: list[Posted | None]) -> None:
        """All batches are noted; there is nothing left to do."""

    def abort(self, messages: list[Posted | None]) -> None:
        """What was taken stays noted, so that writing again posts the rest."""


class PostStreamWriter(_Poster, DataSourceStreamWriter):
    def commit(self, messages: list[Posted | None], batchId: int) -> None:  # noqa: N803
        """As for tables: a batch of the stream that runs again posts nothing twice."""

    def abort(self, messages: list[Posted | None], batchId: int) -> None:  # noqa: N803
        """As for tables."""


class PostSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "millrace_post"

    def writer(self, schema, overwrite: bool) -> PostWriter:
        return PostWriter(self.options)

    def streamWriter(self, schema, overwrite: bool) -> PostStreamWriter:  # noqa: N802
        return PostStreamWriter(self.options)


def posted(df: DataFrame, url: str, sent: str, **options: str) -> None:
    """Posts all rows (S33). They are dealt and sorted by all their columns, so that a second run makes the same batches."""
    rows = df.repartition(*df.columns).sortWithinPartitions(*df.columns)
    rows.write.format("millrace_post").mode("append").options(url=url, sent=sent, **options).save()
