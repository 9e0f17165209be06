"""functions of the security event engine."""
