"""Tesserae: retrieval, conversation and evaluation analytics as Spark DataFrames."""
