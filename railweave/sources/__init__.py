"""Feeds from zip archives."""
