"""Array, sorting, linear algebra, graph and placement operators as DataFrame plans."""
