"""Operators over training corpora: quality, toxicity, duplicates, decontamination, tokens, licences, secrets, pages."""
