"""What can go wrong, by what a caller can do about it."""


class LakeError(Exception):
    """Base of all errors that this package raises on purpose."""


class RetryableError(LakeError):
    """Trying again may help: time-outs, throttling, unavailable services."""


class NonRetryableError(LakeError):
    """Trying again cannot help: bad requests, missing files, unknown formats."""


class SchemaError(NonRetryableError):
    """Data without the shape that it is required to have."""


class QualityError(NonRetryableError):
    """A critical data-quality rule failed and the caller asked to stop."""
