"""Operators on interaction streams: lifetimes, rewards, graphs, solvers, influence sketches."""
