"""Errors of the engine. Errors of single rows surface as Spark's own when an action runs."""


class LodestoneError(Exception):
    pass


class InvalidMagic(LodestoneError, ValueError):
    pass


class InvalidHeader(LodestoneError, ValueError):
    pass


class CorruptedFooter(LodestoneError, ValueError):
    pass


class CorruptedData(LodestoneError, ValueError):
    pass


class ChecksumMismatch(LodestoneError, ValueError):
    pass


class EmptyDataset(LodestoneError, ValueError):
    pass


class InvalidTag(LodestoneError, ValueError):
    pass


class QuantizationOverflow(LodestoneError, ValueError):
    pass


class DimensionMismatch(LodestoneError, ValueError):
    def __init__(self, expected: int, found: int):
        super().__init__(f"dimension mismatch: expected {expected}, found {found}")
        self.expected, self.found = expected, found


class IndexOutOfBounds(LodestoneError, IndexError):
    def __init__(self, index: int, count: int):
        super().__init__(f"index {index} is out of bounds for {count} vectors")
        self.index, self.count = index, count
