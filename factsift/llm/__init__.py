"""Training-data operators: thirteen stand-alone jobs over documents, pages, embeddings and conversations.

Nothing else in the package imports this subpackage. Each module holds one
operator; ``queries`` registers the thin contract queries.
"""
