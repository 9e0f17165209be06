"""sources of the security event engine."""
