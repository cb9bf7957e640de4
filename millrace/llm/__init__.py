"""Operations of a large-scale training-data pipeline, each usable on its own.

Nothing outside this subpackage imports it.  `queries.py` holds the registered
queries and their SQL; every operator module has a general interface of its own.
"""
