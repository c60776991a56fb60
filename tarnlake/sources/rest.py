"""Paged REST tables as a Spark data source: a page to a task, with retries and checked payloads."""

from __future__ import annotations

import json
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator
from typing import Any

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..control import retry
from ..errors import NonRetryableError, RetryableError, SchemaError

#: HTTP codes worth another try.
RETRYABLE = frozenset({429, 500, 502, 503, 504})
FIELDS = ("id", "base", "quote", "rate", "updated_at")


class ApiClient:
    """Bearer-authorized JSON client with classified errors."""

    def __init__(self, url: str, token: str, timeout: float = 10.0, page_size: int = 100, attempts: int = 5, base_delay: float = 0.5):
        self.url, self.token, self.timeout, self.page_size = url.rstrip("/"), token, timeout, page_size
        self._send = retry(attempts, base_delay)(self._once)

    def _once(self, path: str, body: bytes | None = None) -> Any:
        request = urllib.request.Request(f"{self.url}/{path}", data=body, headers={"Authorization": f"Bearer {self.token}", "Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as r:
                return json.load(r)
        except urllib.error.HTTPError as e:
            kind = RetryableError if e.code in RETRYABLE else NonRetryableError
            raise kind(f"{path}: HTTP {e.code}") from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise RetryableError(f"{path}: {e}") from e
        except ValueError as e:
            raise SchemaError(f"{path}: not JSON") from e

    def page(self, number: int, updated_since: str | None = None) -> dict:
        query = {"page": number, "page_size": self.page_size} | ({"updated_since": updated_since} if updated_since else {})
        return validated(self._send(f"rates?{urllib.parse.urlencode(query)}"))

    def pages(self, updated_since: str | None = None) -> Iterator[dict]:
        number = 1
        while True:
            p = self.page(number, updated_since)
            yield p
            if not p["pagination"].get("has_next"):
                return
            number += 1

    def all(self, updated_since: str | None = None) -> list[dict]:
        return [r for p in self.pages(updated_since) for r in p["data"]]

    def post_log(self, body: dict) -> Any:
        return self._send("ingest-log", json.dumps(body).encode())


def validated(payload: Any) -> dict:
    if not isinstance(payload, dict) or not isinstance(payload.get("data"), list) or not isinstance(payload.get("pagination"), dict):
        raise SchemaError("a page needs data and pagination")
    for r in payload["data"]:
        if missing := [f for f in FIELDS if f not in r]:
            raise SchemaError(f"a record lacks {missing}")
    return payload


class _Pages(InputPartition):
    """Pages from ``first`` to ``last``; without a last page, as long as the server says that there are more."""

    def __init__(self, first: int, last: int | None):
        self.first, self.last = first, last


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        o = {k.lower(): v for k, v in options.items()}
        self.since = o.get("updatedsince")
        self.make = lambda: ApiClient(o["url"], o.get("token", ""), float(o.get("timeout", 10)), int(o.get("pagesize", 100)), int(o.get("attempts", 5)), float(o.get("basedelay", 0.5)))

    def partitions(self) -> list[InputPartition]:
        """A task to each page that the first one counts; the last goes on while the server has more.

        Where the server does not count, one task follows ``has_next`` from the first page on.
        """
        p = self.make().page(1, self.since)["pagination"]
        total, size = p.get("total"), p.get("page_size")
        if total is None or not size:
            return [_Pages(1, None)]
        pages = max(1, -(-int(total) // int(size)))
        return [*(_Pages(i, i) for i in range(1, pages)), _Pages(pages, None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        client, number = self.make(), partition.first
        while True:
            p = client.page(number, self.since)
            for r in p["data"]:
                yield int(r["id"]), r["base"], r["quote"], float(r["rate"]), r["updated_at"]
            if number == partition.last or not p["pagination"].get("has_next"):
                return
            number += 1


class RatesSource(DataSource):
    """spark.dataSource.register(RatesSource); spark.read.format("rates").options(url=..., token=...).load()"""

    @classmethod
    def name(cls) -> str:
        return "rates"

    def schema(self) -> str:
        return "id int, base string, quote string, rate double, updated_at string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))
