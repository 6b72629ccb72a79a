"""Typed errors of the analysis steps."""


class CasegateError(Exception):
    """Base class of all errors raised here."""


class EmptyLogError(CasegateError):
    """Nothing is left of the log (or of its attributes) after cleaning."""


class NoKnockoutsError(CasegateError):
    """No knock-out activity or outcome was found, or every case is rejected."""


class NoActivitiesError(CasegateError):
    """A quality measure was asked for over an empty set of activities."""


class ImpossibleOrderError(CasegateError):
    """No order of the checks satisfies all constraints."""


class UnsupportedFileError(CasegateError):
    """The file extension is not one of the supported log formats."""


class RuleLearningError(CasegateError):
    """Rule learning was asked for with unusable settings."""


class LogNotLoadedError(CasegateError):
    """An analysis step was called before there was a log to analyse."""
