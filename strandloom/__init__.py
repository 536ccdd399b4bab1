"""Part of the strandloom analytics engine."""
