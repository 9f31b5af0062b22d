"""Readers, writers and derived graphs."""
