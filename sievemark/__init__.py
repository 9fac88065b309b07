"""Detectability analytics and text-corpus operators on Spark."""
