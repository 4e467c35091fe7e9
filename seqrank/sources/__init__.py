"""Readers and writers for FASTA, annotation, tables and reports."""
