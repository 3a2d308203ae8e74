"""Table-level jobs composed from operators."""
