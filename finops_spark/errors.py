"""Errors raised at plan time or by a strict gate."""


class FinopsError(Exception):
    """Base of all errors of this package."""


class SchemaError(FinopsError):
    """A required column is missing or has an unusable type."""


class GateError(FinopsError):
    """A data gate was enforced and did not pass."""


class IntervalError(FinopsError):
    """A labelled interval does not fit the price data."""


class SplitError(FinopsError):
    """A split or fold layout cannot be made."""


class FitError(FinopsError):
    """A statistic or model cannot be fitted on the given rows."""
