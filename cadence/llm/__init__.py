"""Operators for large-scale training-data pipelines (one module per operator).

Nothing else in the library imports this subpackage; ``__spark_entry__`` registers
``llm.catalog`` only when it is present.
"""
