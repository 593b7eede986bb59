"""Operators of a training-data pipeline, and their registered queries."""

from sensorloom.llm import decontam, html, infill, licenses, linedup, packing, pii, quality, runs, setjoin, sharding, simhash, tokenbin
from sensorloom.llm.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "decontam", "html", "infill", "licenses", "linedup", "packing", "pii", "quality", "runs", "setjoin", "sharding", "simhash", "tokenbin"]
