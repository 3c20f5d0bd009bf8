"""sources of the document-graph engine."""
