"""streaming of the security event engine."""
