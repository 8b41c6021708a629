"""Operators for preparing language-model training text on Spark.

Every operator takes DataFrames, returns DataFrames and keeps the work on the executors. Shared rules for
irregular input, unless an operator's docstring says otherwise: a null text behaves as an empty text, a null
``doc_id`` is an ordinary value and comes back as null, repeated rows come back as often as they went in, an
empty table gives an empty result with the full schema, and columns that an operator does not know are ignored.
"""
