"""Panel, cohort and period-load operators for large tables, written as Spark plans."""
