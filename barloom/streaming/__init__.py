"""Streams of formula attempts."""
