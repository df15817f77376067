"""The prediction job as a stream."""
