"""The registered queries: one or more per operator, each with the SQL that must give the same rows."""
