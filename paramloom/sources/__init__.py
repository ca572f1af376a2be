"""Stores and codecs."""
