"""streaming of the document-graph engine."""
