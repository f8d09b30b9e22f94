"""Messages as a stream."""
