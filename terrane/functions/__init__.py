"""Spatial functions."""
