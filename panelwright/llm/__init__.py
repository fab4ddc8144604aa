"""Operators of a training-data pipeline over text corpora.

Nothing outside this subpackage imports it; ``queries`` and ``oracles`` hold
what ``__spark_entry__`` registers.
"""
