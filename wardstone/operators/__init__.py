"""Relational operators over corpora, hits, answers and audit records."""
