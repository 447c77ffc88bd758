"""Dataframe-to-dataframe operators."""
