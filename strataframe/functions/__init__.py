from . import arrays, draws, scalars

__all__ = ["arrays", "draws", "scalars"]
