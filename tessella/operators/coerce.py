"""Arguments as they come from tools and files: texts for numbers, truths and JSON."""

from __future__ import annotations

import json
from typing import Any

# Words for yes and no.
YES, NO = ("1", "true", "yes", "on"), ("0", "false", "no", "off", "")


def truth(value: Any) -> bool:
    """A boolean of a boolean, a number or a word; ValueError for what is neither yes nor no."""
    if value is None or isinstance(value, (bool, int, float)):
        return bool(value)
    word = str(value).strip().lower()
    if word in YES or word in NO:
        return word in YES
    raise ValueError(f"{value!r} is neither yes nor no")


def whole(value: Any, default: int | None = None, least: int | None = None, most: int | None = None) -> int | None:
    """A whole number within bounds; the default for what is none."""
    try:
        if isinstance(value, bool):
            raise ValueError
        number = int(float(value)) if isinstance(value, str) else int(value)
    except (TypeError, ValueError, OverflowError):
        return default
    number = number if least is None else max(least, number)
    return number if most is None else min(most, number)


def structure(value: Any) -> Any:
    """What a JSON text holds if it is a list or an object, else the value itself."""
    if isinstance(value, str) and value.strip()[:1] in ("[", "{"):
        try:
            return json.loads(value)
        except ValueError:
            return value
    return value


def like(default: Any, value: Any) -> Any:
    """A setting's value in the type of its default."""
    if isinstance(default, bool):
        return truth(value)
    if isinstance(default, int):
        return whole(value, default)
    if isinstance(default, float):
        try:
            return float(value)
        except (TypeError, ValueError):
            return default
    return structure(value) if isinstance(default, (list, dict)) else str(value)
