"""Training-data operators: dedup, decontamination, scoring, mixing and sharding.

Nothing else in the library imports this subpackage.
"""
