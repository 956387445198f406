"""Training-data operators: one module per operator, the queries in :mod:`frontwave.llm.queries`.

Nothing outside this subpackage imports it, except the guarded import in ``__spark_entry__.py``.
"""
