from . import blocks, catalogue, evaluation, tokens  # noqa: F401  (the others add to the catalogue's queries)
