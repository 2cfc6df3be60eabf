"""sources of seqforge."""
