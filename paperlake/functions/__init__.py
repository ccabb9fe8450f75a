"""Column functions: URLs, HTML, headings, scalar helpers."""
