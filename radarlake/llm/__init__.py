"""Operators of a large-scale training-data pipeline.

Nothing else in the library imports this subpackage. Modules are imported one by
one so that an executor loads only what the operator at hand needs.
"""
