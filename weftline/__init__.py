"""Spark-first analytics of web content: pages to Markdown, quality, libraries, changes, structured attributes."""
