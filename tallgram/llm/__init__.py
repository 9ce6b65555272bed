"""Operators of a training-data pipeline: cleaning, de-duplication, decontamination, tokenisation."""
