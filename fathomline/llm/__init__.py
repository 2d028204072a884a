"""Corpus preparation at scale: decontamination, toxicity, personal data, search, packing, dedup and extraction."""
