"""Operators for building training data: dedup, decontamination, mixing, language, secrets, search, archives."""
