"""quern: web-crawl analytics as composable PySpark DataFrame operators."""
