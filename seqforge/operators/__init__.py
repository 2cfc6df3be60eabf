"""operators of seqforge."""
