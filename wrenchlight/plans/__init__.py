"""KPI plans: each takes a ``Context`` and returns one lazy DataFrame."""
