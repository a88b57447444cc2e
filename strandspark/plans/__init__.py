"""Models, their transforms, and command pipelines."""
