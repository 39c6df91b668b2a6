"""Exceptions of the engine."""


class ReplicaError(Exception):
    """Base of all errors here."""


class NetworkError(ReplicaError):
    def __init__(self, message: str, retryable: bool = True):
        super().__init__(message)
        self.retryable = retryable


class MigrationError(ReplicaError):
    pass


class UserSwitchError(ReplicaError):
    pass


class SourceError(ReplicaError):
    pass


class EntityNotFound(ReplicaError):
    pass


class UnsupportedFilter(ReplicaError):
    pass
