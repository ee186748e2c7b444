"""Document analytics on Spark: profile, split, mask, validate, look up, report and render text at scale."""

__version__ = "0.1.0"
