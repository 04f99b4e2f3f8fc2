"""framescope: curation, label auditing and corpus preparation as Spark plans."""
