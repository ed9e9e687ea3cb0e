"""Operators: DataFrame in, DataFrame out; none of them makes a session or starts a job unless it says so."""
