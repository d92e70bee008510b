"""Streams of survey data."""
