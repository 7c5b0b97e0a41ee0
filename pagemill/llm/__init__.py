"""Training-data operators: decontamination, dedup, classification, mixing, scanning and token output.

Nothing outside this subpackage imports it.
"""
