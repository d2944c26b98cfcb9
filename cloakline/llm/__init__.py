"""Training-data operators: decontamination, packing, extraction, scoring, token output.

Nothing outside this subpackage imports it.
"""
