"""Operators for training data: similar vectors, score fusion, token ids, mixing, languages."""
