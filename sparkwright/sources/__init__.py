"""Tables and fixtures."""
