"""Response envelopes around small collected results."""

from __future__ import annotations

from typing import Any

from .constants import ERRORS


def success(data: Any, request_id: str | None = None) -> dict:
    return {"success": True, "data": data, "error": None, "request_id": request_id}


def failure(code: str, message: str, detail: Any = None, request_id: str | None = None) -> dict:
    """The error envelope; unknown codes are internal errors and show no detail."""
    if code not in ERRORS:
        code, detail = "ERR_INTERNAL", None
    return {"success": False, "data": None, "error": {"error_code": code, "http_status": ERRORS[code], "message": message, "detail": detail}, "request_id": request_id}


def page(items: list, total: int, number: int, size: int) -> dict:
    return {"items": items, "total": total, "page": number, "page_size": size}
