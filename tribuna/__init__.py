"""Analytics for public-hearing corpora, declared as Spark DataFrame plans."""
