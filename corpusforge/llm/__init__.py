"""Operators for large training corpora: mixing, near duplicates, extraction, filters.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries when it can be imported.
"""
