"""Dated-document search and analytics as ordinary Spark DataFrame jobs."""
