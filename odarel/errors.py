"""Errors with an HTTP-like status and a stable code."""

from __future__ import annotations

# Default code of each status.
CODES = {
    400: "BadRequest",
    401: "Unauthorized",
    403: "Forbidden",
    404: "NotFound",
    405: "MethodNotAllowed",
    406: "NotAcceptable",
    409: "Conflict",
    410: "Gone",
    412: "PreconditionFailed",
    413: "PayloadTooLarge",
    422: "UnprocessableEntity",
    424: "FailedDependency",
    428: "PreconditionRequired",
    500: "InternalServerError",
    501: "NotImplemented",
}


class ODataError(Exception):
    def __init__(self, message: str, status: int = 400, code: str | None = None):
        super().__init__(message)
        self.status, self.code = status, code or CODES.get(status, "BadRequest")

    def body(self) -> dict:
        return {"error": {"code": self.code, "message": str(self)}}
