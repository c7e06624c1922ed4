"""Container parsers: bytes to listings whose payloads are read and verified on demand."""
