"""Readers and writers of the record layouts."""
