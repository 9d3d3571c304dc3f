"""Operators for training text: names, turns, repeats, sentences, leaks, mixtures, subjects."""
