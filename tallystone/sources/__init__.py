"""Readers for stored tables, text and markup, and sinks."""
