"""Text of a drawing: pure functions over the few nodes and edges that a view has selected."""
