"""Readloom sources."""
