"""Rubric-assessment analytics as Spark DataFrame jobs."""
