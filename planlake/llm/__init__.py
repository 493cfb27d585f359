"""Training-data operators: one module each, with their queries and SQL in ``catalogue``.

Nothing outside this folder, ``corpus_pipeline.py`` and ``tests/llm`` imports it.
"""
