"""annoloom: analytics over stand-off text annotations, declared as Spark plans."""
