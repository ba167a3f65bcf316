"""colloquy: training-data jobs over multi-turn generator/verifier conversations, on Spark."""

__version__ = "0.1.0"
