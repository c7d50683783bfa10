"""Readers, writers and derived input views."""
