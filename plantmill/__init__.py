"""Spark jobs that measure plant architecture over whole collections of scans."""
