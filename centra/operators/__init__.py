"""Operators on edge tables."""
