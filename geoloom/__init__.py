"""Batch jobs for terrain, mesh, path and capture tables, written as Spark DataFrame plans."""
