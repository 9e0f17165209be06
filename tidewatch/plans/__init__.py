"""plans of the security event engine."""
