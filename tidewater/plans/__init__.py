"""Composed jobs: the sales report, error-log extraction and run history."""
