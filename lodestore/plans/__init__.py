"""The named queries: ``catalogue`` holds the registry, ``lifecycle`` adds to it."""

from lodestore.plans import catalogue, lifecycle

__all__ = ["catalogue", "lifecycle"]
