"""Readers of transcripts and the archive sink."""
