"""Operators of a training-data pipeline (packing, scoring, decontamination, deduplication, filters).

Nothing outside this subpackage imports it; ``__spark_entry__`` adds its queries when it is present.
"""
