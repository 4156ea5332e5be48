"""Operators for building language-model training data at scale.

Each module holds one operator with a general interface.  Nothing outside this
subpackage imports it; the registered queries are in ``llm.queries``.
"""
