"""Pages with signed continuation tokens over the full sort tuple."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QueryError

TTL_SECONDS = 900


@dataclass(frozen=True)
class Page:
    rows: DataFrame
    next: str | None
    exhausted: bool
    coverage: str = "complete"
    consistency: str = "available"
    remaining_limit: int | None = None
    holes: DataFrame | None = None
    diagnostics: tuple = field(default=())


def sign(secret: bytes, body: dict) -> str:
    raw = json.dumps(body, sort_keys=True, default=str).encode()
    return base64.urlsafe_b64encode(hmac.new(secret, raw, hashlib.sha256).digest() + raw).decode()


def opened(secret: bytes, token: str, bound: dict) -> dict:
    try:
        data = base64.urlsafe_b64decode(token.encode())
        body = json.loads(data[32:])
    except ValueError as e:
        raise QueryError("rql_cursor_invalid", "not a token") from e
    if not hmac.compare_digest(hmac.new(secret, data[32:], hashlib.sha256).digest(), data[:32]):
        raise QueryError("rql_cursor_invalid", "signature")
    if any(body.get(k) != v for k, v in bound.items()):
        raise QueryError("rql_cursor_mismatch", "the token belongs to another query")
    if body["until"] < time.time():
        raise QueryError("rql_cursor_expired", "")
    return body


def past(columns: list[tuple[Column, bool, bool]], last: list[Any]) -> Column:
    """Rows after the last one in the order of the columns (column, descending, whether nulls count as least)."""
    out = F.lit(False)
    for (c, desc, nulls_least), v in zip(reversed(columns), reversed(last), strict=True):
        if v is None:
            beyond = c.isNotNull() if nulls_least != desc else F.lit(False)
            same = c.isNull()
        else:
            v = F.lit(v)
            beyond = (c < v) if desc else (c > v)
            if nulls_least == desc:
                beyond = beyond | c.isNull()
            same = c == v
        out = F.coalesce(beyond, F.lit(False)) | (F.coalesce(same, F.lit(False)) & out)
    return out
