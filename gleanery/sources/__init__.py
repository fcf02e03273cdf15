"""Readers and sinks: direct content, files, stored responses, sitemaps, the chunk collection."""
