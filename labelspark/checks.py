"""Checks of parameters, with one wording for all of them."""

from __future__ import annotations


def require(name: str, value, allowed: str, holds: bool) -> None:
    """Raise unless ``holds``: says which argument has which value and what is allowed."""
    if not holds:
        raise ValueError(f"argument {name} is {value!r}; allowed: {allowed}")
