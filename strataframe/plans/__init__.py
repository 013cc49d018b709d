from . import hashed, moments, ordered, quantiles

__all__ = ["hashed", "moments", "ordered", "quantiles"]
