"""Extension: indexing files as they arrive."""
