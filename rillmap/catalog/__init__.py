"""All registered queries, by area."""
from rillmap.catalog import cleaning, evaluation, linear, linkage, modelling, scalars, spatial_points, spatial_shapes, storage  # noqa: F401
from rillmap.catalog.base import ORACLES, QUERIES  # noqa: F401
