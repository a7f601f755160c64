"""Named queries over the tables of a data folder."""

from formlake.plans import registry
from formlake.plans import corpus as _corpus
from formlake.plans import fixtures as _fixtures
from formlake.plans import measured as _measured

__all__ = ["registry"]
_ = (_corpus, _fixtures, _measured)
