"""Panels and counters over streams; an extension of the batch operators."""
