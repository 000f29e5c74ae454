"""A Python data source over paginated HTTP JSON endpoints.

spark.dataSource.register(RestSource); spark.read.format("millrace_rest").schema(...).options(url=..., endpoint=..., params='{"ticker": "X"}').load()

Equality filters on columns named in ``pushed`` become request parameters. Each entry of the list parameter named in ``split`` is a
partition of its own. ``body`` makes it a POST. The network call is replaceable for tests: ``opener`` names a module and function.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Iterable, Iterator
from urllib.parse import urlencode

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition


def serialise(params: dict) -> str:
    """Query string of parameters: lists as repeated keys, nulls left out."""
    pairs = [(k, v) for k, vs in params.items() for v in (vs if isinstance(vs, list) else [vs]) if v is not None]
    return urlencode(pairs)


def http_get(url: str, body: bytes | None, headers: dict) -> dict:
    """One request; the answer as JSON."""
    from urllib.request import Request, urlopen

    with urlopen(Request(url, data=body, headers=headers), timeout=30) as answer:
        return json.load(answer)


class _Part(InputPartition):
    def __init__(self, params: dict):
        self.params = params


class RestReader(DataSourceReader):
    def __init__(self, options: dict, schema):
        self.options, self.schema = options, schema
        self.params = json.loads(options.get("params", "{}"))
        self.pushed = [c for c in options.get("pushed", "").split(",") if c]

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in self.pushed:
                self.params[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        by = self.options.get("split")
        values = self.params.get(by) if by else None
        return [_Part({**self.params, by: v}) for v in values] if isinstance(values, list) and values else [_Part(self.params)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        module, _, name = self.options.get("opener", f"{__name__}:http_get").partition(":")
        fetch = getattr(importlib.import_module(module), name)
        url, root = self.options["url"].rstrip("/") + self.options.get("endpoint", ""), self.options.get("root", "data")
        headers = json.loads(self.options.get("headers", "{}"))
        token, pages, seen = None, int(self.options.get("pages", "1")), set()
        key = self.options.get("key")
        for _ in range(min(pages, 5)):  # at most five pages, as a guard against endless cursors (S30)
            params = {**partition.params, **({self.options.get("cursor", "next_token"): token} if token else {})}
            if "body" in self.options:
                answer = fetch(url, json.dumps({**json.loads(self.options["body"]), **params}).encode(), headers)
            else:
                answer = fetch(f"{url}?{serialise(params)}", None, headers)
            for row in answer.get(root, []):
                if key is None or row.get(key) not in seen:
                    seen.add(row.get(key))
                    yield tuple(_fit(row.get(f.name)) for f in self.schema.fields)
            token = answer.get("meta", {}).get(self.options.get("cursor", "next_token"))
            if not token:
                break


def _fit(value):
    return json.dumps(value) if isinstance(value, dict) else value


class RestSource(DataSource):
    """The source."""

    @classmethod
    def name(cls) -> str:
        return "millrace_rest"

    def reader(self, schema) -> DataSourceReader:
        return RestReader(dict(self.options), schema)
