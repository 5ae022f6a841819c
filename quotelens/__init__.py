"""quotelens: point-in-time features, audits and scoring for quote data, as Spark plans."""
