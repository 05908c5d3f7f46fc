"""Settings from an environment: a blank value counts as none."""

from __future__ import annotations

from collections.abc import Mapping


def parse_env(text: str) -> dict[str, str]:
    """KEY=VALUE lines; comments, blank lines and an export before the key are passed over, quotes around a value go."""
    out: dict[str, str] = {}
    for line in text.splitlines():
        line = line.strip().removeprefix("export ").strip()
        if line and not line.startswith("#") and "=" in line:
            key, value = (p.strip() for p in line.split("=", 1))
            out[key] = value[1:-1] if len(value) > 1 and value[0] == value[-1] and value[0] in "'\"" else value
    return out


def text(env: Mapping[str, str], key: str, default: str | None = None) -> str | None:
    return (env.get(key) or "").strip() or default


def flag(env: Mapping[str, str], key: str, default: bool = False) -> bool:
    value = text(env, key)
    return default if value is None else value.casefold() in ("1", "true", "yes", "on")


def whole(env: Mapping[str, str], key: str, default: int | None = None, least: int | None = None) -> int | None:
    """A whole number, no less than `least`; the default where there is none or it can't be read."""
    value = text(env, key)
    try:
        number = default if value is None else int(value)
    except ValueError:
        number = default
    return number if number is None or least is None else max(number, least)
