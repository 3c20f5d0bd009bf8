"""functions of the document-graph engine."""
