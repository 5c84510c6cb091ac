"""Frame-level behavioural signal analytics, declared as Spark plans."""
