"""Part of the archive analytics engine."""
