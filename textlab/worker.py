"""A place for costly objects that lives as long as a Python worker.

Functions shipped by value get fresh module globals in every task, so a global
cache would start empty each time. This one hangs on ``sys.modules`` and is
shared by all tasks that a worker process runs one after the other.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Hashable

_NAME = "textlab_worker_objects"


def worker_object(key: Hashable, make: Callable[[], object]):
    """The object under ``key``, made at its first use in this process. The key
    must name everything that ``make`` depends on."""
    holder = sys.modules.get(_NAME)
    if holder is None:
        holder = types.ModuleType(_NAME)
        holder.objects = {}
        sys.modules[_NAME] = holder
    if key not in holder.objects:
        holder.objects[key] = make()
    return holder.objects[key]


def forget_worker_objects() -> None:
    """Drops all objects of this process: for tasks that need the memory and
    none of them. Reused workers would otherwise hold those of earlier stages."""
    holder = sys.modules.get(_NAME)
    if holder is not None:
        holder.objects.clear()
