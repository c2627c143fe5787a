"""Signed tokens: what a client must hand back unchanged."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import time

from odarel.errors import ODataError

SKIP_TTL, DELTA_TTL = 900, 604_800


def _b64(raw: bytes) -> str:
    return base64.urlsafe_b64encode(raw).rstrip(b"=").decode()


def _raw(text: str) -> bytes:
    return base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def sign(payload: dict, secret: str, now: float | None = None) -> str:
    body = json.dumps(payload | {"issuedAt": int(time.time() if now is None else now)}, sort_keys=True, default=str).encode()
    return f"{_b64(body)}.{_b64(hmac.new(secret.encode(), body, hashlib.sha256).digest())}"


def verify(token: str, secret: str, ttl: int, *, expired: int = 400, now: float | None = None) -> dict:
    """The payload; 400 for a token that isn't ours, ``expired`` for one that is too old."""
    try:
        body, mark = map(_raw, token.split("."))
        payload = json.loads(body)
    except (ValueError, TypeError):
        raise ODataError("invalid token") from None
    if not isinstance(payload, dict) or not hmac.compare_digest(mark, hmac.new(secret.encode(), body, hashlib.sha256).digest()):
        raise ODataError("invalid token")
    age = (time.time() if now is None else now) - payload.get("issuedAt", 0)
    if age > ttl or age < -60:
        raise ODataError("the token has expired", expired)
    return payload
