"""Readers and writers: reports, labels, prediction log, evaluation, models."""
