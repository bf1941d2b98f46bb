"""Engine options."""

from __future__ import annotations

from dataclasses import dataclass, field

from .constants import MIME_TYPES, REVIEW_THRESHOLD, TEXT_BUDGET_TOKENS, TOLERANCE


def listed(value: str | list[str] | tuple[str, ...]) -> tuple[str, ...]:
    """A comma-separated text as a tuple: stripped, without empty parts; lists stay."""
    parts = value.split(",") if isinstance(value, str) else value
    return tuple(p.strip() for p in parts if p.strip())


@dataclass(frozen=True)
class Settings:
    tolerance: str = TOLERANCE
    review_threshold: float = REVIEW_THRESHOLD
    text_budget_tokens: int = TEXT_BUDGET_TOKENS
    mime_types: tuple[str, ...] = field(default=MIME_TYPES)
    store: str = "store"
    organization: str = "default"
    default_model: str = "gpt-4o-mini"
    prompt_version: str = "v1"
