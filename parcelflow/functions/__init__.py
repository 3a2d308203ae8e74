"""Column-expression builders used inside the table-level jobs."""
