"""All registered queries. Importing the sections fills the registry."""

from sensorloom.catalog import cleaning, learning, profiles, scalars, windows
from sensorloom.catalog.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
