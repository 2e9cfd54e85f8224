"""Analytics for crawl-style content indexes, written as Spark jobs."""
