"""Document analytics on Spark: detect, convert to Markdown, diagnose, roll up."""

__version__ = "0.1.0"
