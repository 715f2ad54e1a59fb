"""Counting what arrives: streams of alignments and of log rows."""
