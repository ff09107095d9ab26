"""The operators on the test tables, and the SQL each result must agree with."""
