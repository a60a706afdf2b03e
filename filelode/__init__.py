"""Filelode: file-metadata analytics and corpus preparation as Spark jobs."""
