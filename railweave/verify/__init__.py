"""Checks itineraries against the raw timetable.

Nothing here may import the planner (railweave.plans): a test walks the imports.
"""
