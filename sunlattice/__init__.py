"""Site-potential analytics expressed as lazy Spark plans."""
