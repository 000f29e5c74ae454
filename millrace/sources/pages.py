"""Web pages fetched in tasks, a batch of addresses at a time."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from email.message import Message
from urllib.error import HTTPError
from urllib.parse import urljoin, urlsplit
from urllib.request import HTTPRedirectHandler, Request, build_opener

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Statuses that redirect, how many of them are followed, seconds for an address with all its redirects.
REDIRECTS, MOST_REDIRECTS, TIMEOUT_S = (301, 302, 303, 307, 308), 3, 30.0
FIELDS = "final_url string, status int, content_type string, body string, error string"

#: Answers one address without following it: (url, seconds) to status, headers in lower case, body.
Opener = Callable[[str, float], tuple[int, dict[str, str], bytes]]


class _Unfollowed(HTTPRedirectHandler):
    def redirect_request(self, *args, **kwargs):
        return None


def http_open(url: str, seconds: float) -> tuple[int, dict[str, str], bytes]:
    """One request by HTTP."""
    request = Request(url, headers={"Accept": "*/*", "Accept-Language": "en-US,en;q=0.9"})
    try:
        answer = build_opener(_Unfollowed).open(request, timeout=seconds)
    except HTTPError as refused:
        answer = refused
    with answer:
        return answer.status, {k.lower(): v for k, v in answer.headers.items()}, answer.read()


def decoded(body: bytes, content_type: str | None) -> str:
    """The body in the charset that its type names, else in UTF-8; what cannot be read is replaced."""
    header = Message()
    header["content-type"] = content_type or "application/octet-stream"
    try:
        return body.decode(header.get_content_charset() or "utf-8", "replace")
    except LookupError:
        return body.decode("utf-8", "replace")


def fetch(url: str | None, opener: Opener = http_open, most: int = MOST_REDIRECTS, seconds: float = TIMEOUT_S) -> dict:
    """One page with its redirects followed by hand (S28): final_url, status, content_type, body, error.

    The error is null for a page that came; else invalid_url (no http or https address, at any hop), no_location, too_many_redirects,
    redirect_loop (an address that a redirect has led to before), failed (any other status; the body is kept), or what the connection raised.
    """
    end, led_to, at = time.monotonic() + seconds, [], url
    page = dict.fromkeys(("final_url", "status", "content_type", "body", "error"))
    while True:
        try:
            known = urlsplit(at or "")
            if known.scheme not in ("http", "https") or not known.hostname:
                return page | {"error": "invalid_url"}
        except ValueError:
            return page | {"error": "invalid_url"}
        try:
            if end <= time.monotonic():
                raise TimeoutError
            status, headers, body = opener(at, end - time.monotonic())
        except Exception as broken:  # any failure of a connection is the page's, not the job's
            return page | {"final_url": at, "error": type(broken).__name__}
        page |= {"final_url": at, "status": status}
        if status not in REDIRECTS:
            kind = headers.get("content-type", "application/octet-stream")
            return page | {"content_type": kind, "body": decoded(body, kind), "error": None if 200 <= status < 300 else "failed"}
        if not headers.get("location"):
            return page | {"error": "no_location"}
        at = urljoin(at, headers["location"])
        if len(led_to) == most:
            return page | {"error": "too_many_redirects"}
        if at in led_to:
            return page | {"error": "redirect_loop"}
        led_to.append(at)


def fetched(df: DataFrame, url: str = "url", opener: Opener = http_open, threads: int = 16, most: int = MOST_REDIRECTS, seconds: float = TIMEOUT_S) -> DataFrame:
    """Rows with the page of their address in a column ``page`` (S28); for extracted(), take page.body and page.content_type.

    Each task keeps ``threads`` requests open. A failure is a value, so a page that does not come fails no job; a task that is run again
    asks again. Spread the addresses over as many partitions as requests may run at once, divided by the threads.
    """

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for urls in batches:
                found = pool.map(lambda u: fetch(u if isinstance(u, str) else None, opener, most, seconds), urls)
                yield pd.DataFrame(list(found), columns=["final_url", "status", "content_type", "body", "error"]).astype({"status": "Int32"})

    return df.withColumn("page", run.asNondeterministic()(F.col(url)))
