"""streaming of seqforge."""
