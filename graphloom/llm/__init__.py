"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``queries.py`` lists what
``__spark_entry__.py`` registers from it.
"""
