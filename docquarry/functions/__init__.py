"""Text functions, word forms and snippets."""
