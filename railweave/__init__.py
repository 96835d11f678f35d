"""Timetable analytics and route planning on PySpark DataFrames."""

__version__ = "0.1.0"
