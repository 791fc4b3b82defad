from . import iupac, prob, seq  # noqa: F401
