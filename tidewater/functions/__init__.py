"""Column -> Column helpers: time zones, dates, durations, text and log lines."""
