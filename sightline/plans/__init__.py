"""All registered queries."""

from sightline.plans import (  # noqa: F401
    classification,
    collection,
    counters,
    files,
    health,
    listing,
    nodes,
    similarity,
    streams,
    verification,
)
from sightline.plans.registry import ORACLES, QUERIES  # noqa: F401
