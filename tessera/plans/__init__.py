"""Views over flat buffers, expression trees, and the choice of a physical strategy."""
