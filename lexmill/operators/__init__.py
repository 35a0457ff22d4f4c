"""DataFrame operators of the corpus engine, one module per group."""
