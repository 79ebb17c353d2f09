"""Bounds, rank metrics, numbering and storage."""
