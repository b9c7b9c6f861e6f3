"""Event-listing analytics on Spark: cleaning, matching, enrichment and audits as DataFrame transforms."""
