"""Chunks, embeddings, lexical and vector candidates, fusion, reread, bundles."""
