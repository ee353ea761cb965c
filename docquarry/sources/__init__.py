"""Where documents, changes and queries come from."""
