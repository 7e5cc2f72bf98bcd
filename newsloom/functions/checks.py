"""Arguments from outside, checked before any plan is built. Each returns the cleaned values or raises ValueError."""

from __future__ import annotations

# What the interface accepts.
SEARCH_TYPES = ("all", "news", "teams", "players", "competitions")
ENTITY_TYPES = ("sport", "competition", "team", "player")
LANGUAGES = ("vi", "en")


def _text(name: str, value: object, least: int, most: int, trim: bool = False) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{name} must be text")
    value = value.strip() if trim else value
    if not least <= len(value) <= most:
        raise ValueError(f"{name} must have {least} to {most} characters")
    return value


def _one_of(name: str, value: object, allowed: tuple[str, ...]) -> str:
    if value not in allowed:
        raise ValueError(f"{name} must be one of {', '.join(allowed)}")
    return value


def search(q: object, type: object = "all") -> dict[str, str]:  # noqa: A002
    return {"q": _text("q", q, 2, 80, trim=True), "type": _one_of("type", type, SEARCH_TYPES)}


def bookmark(news_cluster_id: object, action: object) -> dict[str, str]:
    return {"news_cluster_id": _text("news_cluster_id", news_cluster_id, 1, 80), "action": _one_of("action", action, ("save", "remove"))}


def follow(entity_type: object, entity_id: object, action: object) -> dict[str, str]:
    return {
        "entity_type": _one_of("entity_type", entity_type, ENTITY_TYPES), "entity_id": _text("entity_id", entity_id, 1, 80),
        "action": _one_of("action", action, ("follow", "unfollow")),
    }


def profile(display_name: object, language: object, timezone: object) -> dict[str, str]:
    return {"display_name": _text("display_name", display_name, 2, 60, trim=True), "language": _one_of("language", language, LANGUAGES), "timezone": _text("timezone", timezone, 3, 64)}
