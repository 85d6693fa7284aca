"""Settings of the listing engine, with the defaults that it is expected to have."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    match_threshold: float = 65
    max_results_per_source: int = 25
    digest_max_rows: int = 0
    digest_max_chars: int = 3500
    digest_min_chars: int = 500
    freshness_hours: int = 24
    failures_before_pause: int = 3
    pause_hours: int = 24
    min_interval_minutes: int = 10
    default_interval_minutes: int = 15
    discarded_list_limit: int = 20
    timezone: str = "America/Bogota"
    only_easy_apply: bool = False
    digest_title: str = "Ofertas nuevas recomendadas"
    detected_label: str = "Detectada"
    recipients: tuple[str, ...] = field(default_factory=tuple)


DEFAULTS = Settings()


def truthy(value: str | None) -> bool:
    """Whether an environment value switches a flag on."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on", "si")


def recipients(raw: str | None, fallback: str | None = None) -> list[str]:
    """Comma-separated recipients, else the single fallback."""
    found = [x.strip() for x in (raw or "").split(",") if x.strip()]
    return found or [x for x in [(fallback or "").strip()] if x]
