"""operators of the security event engine."""
