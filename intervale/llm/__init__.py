"""Training-data operators.

Nothing else in the library imports this subpackage; it can be deleted whole.
Each operator module has a general interface (texts, spans, files in and out),
``queries.py`` derives the registered digests from it, and ``oracles.py`` holds
the SQL of those that SQL can express.
"""
