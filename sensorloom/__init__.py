"""Sensor time-series analytics written as Spark DataFrame functions."""

from sensorloom.session import build_session, tune_session

__all__ = ["build_session", "tune_session"]
