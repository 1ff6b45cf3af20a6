"""Readers, writers and the mapping of raw tables onto the card domain."""
