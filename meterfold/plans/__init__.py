"""The report catalogue and the SQL that checks it."""
