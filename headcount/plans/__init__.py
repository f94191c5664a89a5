"""Ready-made pipelines over the operators."""
