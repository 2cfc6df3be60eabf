"""plans of seqforge."""
