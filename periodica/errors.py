"""Errors raised in ``on_invalid='raise'`` mode; panel mode reports rows instead."""


class IntersectionError(Exception):
    """Endogenous and exogenous observations share no period."""


class FrequencyError(ValueError):
    """Exogenous observations are sparser than the endogenous frequency."""


class OverspecifiedError(Exception):
    """The model has at least as many regressors as observations."""


class ImportFailed(Exception):
    """An input file does not follow its declared layout."""


class InvariantError(AssertionError):
    """A dataset breaks one of the rules checked by ``operators.quality``."""
