"""Shuffle-aware building blocks shared by the operators."""
