"""Loads every registered query module and exposes the registry."""

from __future__ import annotations

from . import q_compare, q_ensemble, q_io, q_prepare, q_profile, q_score, q_vectors  # noqa: F401
from .registry import REGISTRY

__all__ = ["REGISTRY"]
