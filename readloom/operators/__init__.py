"""Readloom operators."""
