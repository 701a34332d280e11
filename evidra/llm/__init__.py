"""Training-data operators: one module per operator, queries in :mod:`evidra.llm.queries`."""
