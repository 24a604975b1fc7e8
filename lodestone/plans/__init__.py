"""Query plans over an index, and its storage."""
