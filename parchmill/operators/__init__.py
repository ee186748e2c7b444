"""Operators over tables: blocks, segments, masking, validation, memory, glossary, jobs, models, rendering."""
