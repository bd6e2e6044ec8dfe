"""Analytics for conversational text on Spark."""
