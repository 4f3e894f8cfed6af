"""Training-data operators over documents and embeddings; nothing outside this package imports it."""
