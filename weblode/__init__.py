"""weblode: captured web pages in, media / link / embed / crawl tables out, as Spark jobs."""
