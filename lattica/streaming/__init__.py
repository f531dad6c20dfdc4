"""The status workflow as a stream."""
