"""Colloquy: session and knowledge-base analytics on Spark DataFrames."""
