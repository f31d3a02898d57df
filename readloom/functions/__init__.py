"""Readloom functions."""
