"""All named queries; importing this package fills the registry."""

from lakepipe.plans import (
    basics,
    change_data,
    devices,
    landing,
    loans,
    models,
    quality,
    retail,
    streams,
    turbines,
)
from lakepipe.plans.registry import QUERIES

__all__ = [
    "QUERIES",
    "basics",
    "change_data",
    "devices",
    "landing",
    "loans",
    "models",
    "quality",
    "retail",
    "streams",
    "turbines",
]
