"""marketlens: analytics for priced-outcome markets, written as Spark DataFrame operators."""
