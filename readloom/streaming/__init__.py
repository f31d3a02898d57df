"""Readloom streaming."""
