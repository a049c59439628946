"""Errors by class, and what is reported of each."""

from __future__ import annotations


class EngineError(Exception):
    """An error with a status as services report it and, if it has one, a code."""

    status, error = 500, "Internal Server Error"

    def __init__(self, message: str, code: str | None = None) -> None:
        super().__init__(message)
        self.code = code


class InvalidRequest(EngineError, ValueError):
    status, error = 400, "Bad Request"


class NotFound(EngineError, LookupError):
    status, error = 404, "Not Found"


class Conflict(EngineError):
    status, error = 409, "Conflict"


def report(e: BaseException) -> dict:
    """``status``, ``error``, ``message`` and ``code`` of an error; nothing of an unexpected one's text."""
    if isinstance(e, EngineError):
        return {"status": e.status, "error": e.error, "message": str(e), "code": e.code}
    return {"status": 500, "error": EngineError.error, "message": "An unexpected error occurred", "code": None}
