"""Table readers and result sinks."""
