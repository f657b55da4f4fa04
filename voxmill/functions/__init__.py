"""Helpers that are no operators: dense ids."""
