"""Relational operators: reads, writes, joins, crawl planning, section extraction, reference checks."""
