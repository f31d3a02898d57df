"""Readloom plans."""
