"""Entity tags and their preconditions."""

from __future__ import annotations

import hashlib
import json

from odarel.errors import ODataError


def etag(value) -> str:
    return 'W/"' + hashlib.sha256(json.dumps(value, default=str).encode()).hexdigest()[:32] + '"'


def _tags(header: str) -> set[str]:
    return {x.strip().removeprefix("W/") for x in header.split(",")}


def check(current: str | None, if_match: str | None = None, if_none_match: str | None = None, *, required: bool = False) -> None:
    """412 where the tag differs, 428 where one is needed and none is given."""
    if if_match is None and if_none_match is None:
        if required:
            raise ODataError("If-Match is required", 428)
        return
    own = (current or "").removeprefix("W/")
    if if_match is not None and "*" not in _tags(if_match) and own not in _tags(if_match):
        raise ODataError("the entity has changed", 412)
    if if_none_match is not None and current is not None and ("*" in _tags(if_none_match) or own in _tags(if_none_match)):
        raise ODataError("the entity is there", 412)
