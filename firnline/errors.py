"""What goes wrong, by kind. Each carries the HTTP status that a service would answer with."""

from __future__ import annotations


class FirnlineError(Exception):
    status = 500


class QueryError(FirnlineError):
    """A query that can't be run as it stands."""

    status = 422


class DateSyntaxError(QueryError):
    status = 400


class UnknownDataset(FirnlineError):
    status = 404


class UnknownBasin(FirnlineError):
    status = 404


class BasinNotBurned(FirnlineError):
    """The dataset has no pixels for the basin yet."""

    status = 404


class CoverageError(FirnlineError):
    """The dataset doesn't cover the basin as the query asks."""

    status = 409


class IncompleteData(FirnlineError):
    """A date has only some of the variables asked for."""

    status = 500


class ZoneConfigError(FirnlineError):
    """A dataset sets a parameter that its zone layer does not have."""


class SourceError(FirnlineError):
    """An input that can't be taken in."""


class ExistsError(FirnlineError):
    """Something would be overwritten that was not meant to be."""


class UnknownProblem(FirnlineError):
    """There is no kind of error of that key."""

    status = 404


class NoBasin(FirnlineError):
    """The station has a point but no basin."""

    status = 409


class ConflictError(FirnlineError):
    """Another commit has changed the same dates meanwhile."""

    status = 409
