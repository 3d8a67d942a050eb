"""Training-data operators: ten jobs over documents, pages, conversations and embeddings.

Nothing else in the library imports this subpackage.
"""
