"""Batches: several requests, each with an id and what it depends on."""

from __future__ import annotations

from odarel.errors import ODataError
from odarel.service.engine import Engine

MAX_OPERATIONS, MAX_CHANGESET = 100, 50


def _run(engine: Engine, request: dict, made: dict[str, str]) -> tuple[int, object]:
    method, url = request.get("method", "GET").upper(), request["url"]
    if url.startswith("$") and (ref := url[1:].split("/")[0].split("(")[0].split("?")[0]) in made:
        url = made[ref] + url[1 + len(ref) :]
    headers = {k.lower(): v for k, v in request.get("headers", {}).items()}
    if method == "GET":
        body = engine.get(url, if_none_match=headers.get("if-none-match"), prefer=headers.get("prefer", ""))
        return (204, None) if body is None else (200, body)
    name, _, key = url.removeprefix(engine.config.base).strip("/").partition("(")
    if method == "POST":
        body = engine.create(name, request.get("body") or {})
        if "id" in request and "Location" in body:
            made[str(request["id"])] = body["Location"]
        return 201, body
    entity = engine.catalog.get(name)
    values = engine._key(entity, key.rstrip(")"))
    if method in ("PATCH", "PUT"):
        engine.update(entity.name, values, request.get("body") or {}, if_match=headers.get("if-match"), replace=method == "PUT")
    elif method == "DELETE":
        engine.delete(entity.name, values, if_match=headers.get("if-match"))
    else:
        raise ODataError(f"method {method}", 405, "InvalidMethod")
    return 204, None


def run_batch(engine: Engine, requests: list[dict], *, continue_on_error: bool = True) -> list[dict]:
    """Responses in the requests' order. A request whose dependency failed gets 424; an atomicity group is undone as a whole."""
    if len(requests) > MAX_OPERATIONS:
        raise ODataError(f"a batch has {MAX_OPERATIONS} requests at most", 413, "batch-operation-limit-exceeded")
    ids = [str(r.get("id", i)) for i, r in enumerate(requests)]
    if len(set(ids)) < len(ids):
        raise ODataError("an id is used twice")
    done: dict[str, int] = {}
    groups: dict[str, dict] = {}
    made: dict[str, str] = {}
    out: list[dict] = []
    stopped = False
    for name, request in zip(ids, requests, strict=True):
        group = request.get("atomicityGroup")
        if group is not None:
            size = sum(r.get("atomicityGroup") == group for r in requests)
            if size > MAX_CHANGESET:
                raise ODataError(f"a changeset has {MAX_CHANGESET} requests at most", 413, "changeset-operation-limit-exceeded")
            groups.setdefault(group, {"before": dict(engine.catalog._frames), "failed": False})
        needs = [str(x) for x in request.get("dependsOn", [])]
        failed = [n for n in needs if done.get(n, groups.get(n, {}).get("failed") and 424 or (200 if n in groups else 424)) >= 400]
        if stopped or failed or group is not None and groups[group]["failed"]:
            status, body = 424, ODataError("a request before it failed", 424).body()
        else:
            try:
                status, body = _run(engine, request, made)
            except ODataError as e:
                status, body = e.status, e.body()
        if status >= 400:
            stopped = stopped or not continue_on_error
            if group is not None and not groups[group]["failed"]:
                groups[group]["failed"] = True
                engine.catalog._frames = groups[group]["before"]
                for r in out:
                    if r.get("atomicityGroup") == group:
                        r |= {"status": 424, "body": ODataError("its group was undone", 424).body()}
                        done[r["id"]] = 424
        done[name] = status
        out.append({"id": name, "status": status, "body": body} | ({"atomicityGroup": group} if group is not None else {}))
    return out
