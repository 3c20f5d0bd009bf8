"""operators of the document-graph engine."""
