"""plans of the document-graph engine."""
