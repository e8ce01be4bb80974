"""Operators of the transit engine: tables in, tables out."""
