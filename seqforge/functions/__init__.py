"""functions of seqforge."""
