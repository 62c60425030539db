"""Training-data operators over documents, pages and embeddings.

Nothing outside this subpackage imports it; its queries and SQL are in `alleloom.llm.queries`.
"""
