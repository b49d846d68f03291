"""All named queries; importing this package registers them."""

from nightframe.catalog import (  # noqa: F401
    datasets,
    evaluation,
    expressions,
    inputs,
    operations,
    signals,
    streams,
    windows,
)
from nightframe.catalog.base import ORACLES, QUERIES  # noqa: F401
