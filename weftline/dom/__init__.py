"""HTML trees, selectors, rewriting and Markdown, on the standard library's parser; one parse a page, inside an Arrow stage."""
