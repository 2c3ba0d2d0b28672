"""Captures in SQL: a table function that reads one capture a call, laterally over a table of captures.

    SELECT c.session, r.* FROM captures c, LATERAL capture_rows(c.path, 'payloads') r
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator
from urllib.parse import parse_qsl

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from strataloom.sources import captures, har, structures, wacz

TEXT, LONG = StringType(), LongType()
#: What a call can ask for, and the columns that it then has.
SHAPES = {
    "payloads": {"place": LONG, "url": TEXT, "context_id": TEXT, "target_id": TEXT, "json": TEXT},
    "requests": {"place": LONG, "route": TEXT, "url": TEXT, "status": IntegerType(), "mime": TEXT, "bytes": LONG},
}
PATTERNS = {route: (re.compile(address) if address else None, start) for route, (address, start) in captures.ROUTES.items()}


def route_of(url: str, mime: str) -> str | None:
    """What captures.routed says of one response."""
    return next((r for r, (address, start) in PATTERNS.items() if address and address.search(url) or start and mime.startswith(start)), None)


class Exchange:
    """One request and its response, of whichever kind of capture."""

    def __init__(self, place: int, url: str, variables: str | None, status: int | None, mime: str, body: bytes | None):
        self.place, self.url, self.variables, self.status, self.mime, self.body = place, url, variables, status, mime, body


def har_exchanges(path: str) -> Iterator[Exchange]:
    """The entries of a HAR file, one range after another."""
    with har.opened(path) as file:

        def read(a: int, b: int) -> bytes:
            file.seek(a)
            return file.read(max(0, b - a))

        size = sum(n for _, n in har.listed(path, ""))
        for start in range(0, size, har.RANGE):
            for place, text in har.entries_in(read, size, start, min(size, start + har.RANGE)):
                try:
                    entry = json.loads(text)
                    request, response = entry["request"], entry["response"]
                    content = response.get("content") or {}
                    params = (request.get("postData") or {}).get("params") or []
                    raw = content.get("text")
                    body = raw if raw is None else base64.b64decode(raw) if content.get("encoding") == "base64" else raw.encode()
                except (ValueError, TypeError, KeyError, AttributeError, binascii.Error):
                    continue
                yield Exchange(place, request.get("url") or "", next((p.get("value") for p in params if p.get("name") == "variables"), None), response.get("status"), content.get("mimeType") or "", body)


def wacz_exchanges(path: str) -> Iterator[Exchange]:
    """The 200 and 206 responses of a WACZ archive, in its order."""
    order = wacz.member_order(path)
    for r in sorted(wacz.shares_of(path, wacz.RANGE, 0, 1), key=lambda r: (order[r[0]], r[2])):
        for place, response in wacz.responses_in(path, *r):
            if response.status in (200, 206):
                yield Exchange((order[r[0]] << 44) + place, response.url, dict(parse_qsl(response.posted or "")).get("variables"), response.status, response.mime, response.body())


def in_json(text: str | None, key: str) -> str | None:
    try:
        found = json.loads(text or "{}").get(key)
    except (ValueError, AttributeError):
        return None
    return found if found is None or isinstance(found, str) else json.dumps(found)


def payloads_of(x: Exchange) -> Iterator[tuple]:
    """The rows that structures.response_payloads makes of one response."""
    route, text = route_of(x.url, x.mime), None if x.body is None else x.body.decode("utf-8", "replace")
    if route in ("graphql", "api"):
        in_url = re.search(r"media/([^/?]+)", x.url)
        yield x.place, x.url, in_json(x.variables, "media_id") if route == "graphql" else in_url and in_url[1], in_json(x.variables, "target_id"), text
    elif route == "page":
        found = [(key, data, v) for script in re.findall(captures.SCRIPT, text or "") for key, data in structures.PAGE_KEYS.items() if key in script for v in captures.values_under(script, key) if v.startswith("{")]
        firsts = [first_item(v) for key, _, v in found if key == structures.PAGE_POST]
        context = max((f for f in firsts if f is not None), default=None)
        for key, data, v in found:
            inner = f'{{"{key}": {v}}}'
            yield x.place, x.url, context, None, f'{{"data": {inner}}}' if data else inner


def first_item(value: str) -> str | None:
    try:
        found = json.loads(value)["items"][0]["pk"]
    except (ValueError, KeyError, IndexError, TypeError):
        return None
    return found if found is None or isinstance(found, str) else json.dumps(found)


class CaptureRows:
    """capture_rows(path, what): the payloads of a HAR or WACZ capture, or its requests. `what` is a constant that decides the columns. A null path, and a file of another kind, gives no rows."""

    @staticmethod
    def analyze(path: AnalyzeArgument, what: AnalyzeArgument) -> AnalyzeResult:
        if not what.isConstantExpression or what.value not in SHAPES:
            raise ValueError(f"the second argument of capture_rows is one of {', '.join(SHAPES)}")
        return AnalyzeResult(StructType([StructField(n, t) for n, t in SHAPES[what.value].items()]))

    def eval(self, path: str, what: str) -> Iterator[tuple]:
        exchanges = har_exchanges if (path or "").lower().endswith(".har") else wacz_exchanges if (path or "").lower().endswith(".wacz") else None
        for x in exchanges(path) if exchanges else ():
            if what == "payloads":
                yield from payloads_of(x)
            else:
                yield x.place, route_of(x.url, x.mime), x.url, x.status, x.mime, None if x.body is None else len(x.body)


def register(spark: SparkSession) -> None:
    """Make capture_rows known to the session's SQL."""
    spark.udtf.register("capture_rows", udtf(CaptureRows))
