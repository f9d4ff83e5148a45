"""Tables that a worker process keeps between its tasks.

The processes serve one operator after another. What the last one kept goes when the next one
begins, or the memory of a job of many operators would be that of all of them together.
"""

from __future__ import annotations

_kept: dict[str, dict] = {}


def tables(work: str) -> dict:
    """What this process keeps for `work`; what it kept for any other work is dropped."""
    for other in [w for w in _kept if w != work]:
        _kept.pop(other).clear()
    return _kept.setdefault(work, {})
