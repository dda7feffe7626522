"""The early-stopping rule on a plain list of losses."""

from __future__ import annotations

from collections.abc import Sequence


def has_risen(losses: Sequence[float], patience: int) -> bool:
    """True when every one of the last ``patience`` losses is above the best one before them."""
    return len(losses) > patience and min(losses[-patience:]) > min(losses[:-patience])
