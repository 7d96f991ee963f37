"""Dataset splitting, scoring and grading as Spark jobs."""

__version__ = "0.1.0"
