"""Reports over result tables, and the registered queries."""
