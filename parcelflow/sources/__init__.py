"""Table schemas, readers, writers and landed-payload parsing."""
