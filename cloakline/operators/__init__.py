"""Operators: detectors, identity, collapse, replacement, profiles, selection, summaries, word boxes."""
