"""What the gates raise."""


class AuditError(Exception):
    """Base of all failed audits."""


class MissingHyperparameterError(AuditError):
    pass


class ArchitectureMismatchError(AuditError, ValueError):
    pass


class TemporalDiscontinuityError(AuditError):
    pass


class DataLeakageError(AuditError):
    pass


class DataStarvationError(AuditError):
    pass


class TemporalHoleError(AuditError):
    pass


class PredictionHorizonError(AuditError):
    pass


class NumericalSanityError(AuditError):
    pass
