"""voltrace: event-driven volatility analytics as Spark DataFrame operators."""
