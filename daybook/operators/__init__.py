"""Operators from DataFrame to DataFrame: corpus statistics, search, filters, results, calendars, evaluation."""
