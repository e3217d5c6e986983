"""Market-bar analytics on Spark: ticks to bars, indicators, structure, signals and learning tables."""
