"""Readers and writers of the registry's file formats."""
