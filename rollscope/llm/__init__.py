"""Training-data operators over `documents`, `conversations`, `embeddings` and `benchmark`.

Nothing else in the package imports this subpackage.
"""
