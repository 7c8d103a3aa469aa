"""Motif analytics and text-corpus operations as Spark DataFrame plans."""
