"""All registered queries over the reference operators."""

from . import combine, diff, ingest, qc, score
from .common import Registry

_MODULES = [ingest, score, combine, diff, qc]


def registry() -> Registry:
    found = Registry()
    for module in _MODULES:
        found.queries |= module.R.queries
        found.oracles |= module.R.oracles
    return found
