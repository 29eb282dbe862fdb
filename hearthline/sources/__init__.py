"""Readers and writers for what a chat stack leaves behind."""
