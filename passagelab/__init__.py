"""First-passage analytics and corpus operators as Spark plans."""

__version__ = "0.1.0"
