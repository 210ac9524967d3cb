"""Training-data operators: dedup, decontamination, packing, extraction and scoring over DataFrames.

Nothing outside this subpackage imports it.
"""
