"""Training-data operators over documents, pages, benchmark items and embeddings."""
