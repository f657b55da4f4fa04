"""Derived clouds, shapes and shared scratch tables."""
