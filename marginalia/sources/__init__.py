"""Readers and writers of notes, evaluation files and run records."""
