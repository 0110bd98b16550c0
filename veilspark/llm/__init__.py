"""Training-data operators (deduplication, extraction, tokenisation, mixing).

Nothing outside this package imports it, apart from the guarded registration in ``__spark_entry__``.
"""
