"""Operators for training-data pipelines over text tables.

Nothing outside this subpackage imports it. Every operator selects the columns
it needs by name (extra columns of the caller are neither read nor able to
clash, unless the docstring says they are kept) and defines a result for null,
empty and repeated rows.
"""
