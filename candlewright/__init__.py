"""Market-event forensics on candle tables, expressed as Spark DataFrame operators."""
