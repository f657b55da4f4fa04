"""The registry of named queries."""
