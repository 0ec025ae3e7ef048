"""Where rows come from and go to."""

from .tables import load, relation, save

__all__ = ["load", "relation", "save"]
