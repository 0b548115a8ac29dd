"""Gossamer: whole-web crawl audits as Spark jobs."""
