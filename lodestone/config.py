"""Tags and settings of files, as plain data classes that become reader and writer options."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from enum import IntEnum

from lodestone.errors import InvalidHeader, InvalidTag

MOST_DIMS = 65_535


class QuantType(IntEnum):
    RAW_F32 = 0
    SQ8 = 1
    PRODUCT = 2

    @classmethod
    def of(cls, tag: int) -> QuantType:
        try:
            return cls(tag)
        except ValueError:
            raise InvalidTag(f"invalid quantization tag {tag}") from None


class Metric(IntEnum):
    L2 = 0
    COSINE = 1
    INNER_PRODUCT = 2

    @classmethod
    def of(cls, tag: int | str | Metric) -> Metric:
        """A tag, or a name or alias in any case."""
        if isinstance(tag, str):
            if (m := _ALIASES.get(tag.lower())) is None:
                raise InvalidTag(f"unknown metric {tag!r}")
            return m
        try:
            return cls(tag)
        except ValueError:
            raise InvalidTag(f"invalid metric tag {tag}") from None


_ALIASES = {"l2": Metric.L2, "euclidean": Metric.L2, "cosine": Metric.COSINE, "cos": Metric.COSINE, "ip": Metric.INNER_PRODUCT, "inner": Metric.INNER_PRODUCT, "innerproduct": Metric.INNER_PRODUCT, "inner_product": Metric.INNER_PRODUCT}


def check_dims(dims: int) -> int:
    if dims <= 0:
        raise InvalidHeader("dims must be positive")
    if dims > MOST_DIMS:
        raise InvalidHeader(f"dims {dims} exceed the u16 limit of {MOST_DIMS}")
    return dims


@dataclass(frozen=True)
class FileConfig:
    dims: int
    major: int = 1
    minor: int = 0
    quant_type: QuantType = QuantType.SQ8
    metric: Metric = Metric.L2
    align_blocks: bool = False
    verify: bool = True
    extra: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        check_dims(self.dims)

    def with_(self, **changes) -> FileConfig:
        return replace(self, **changes)

    def writer_options(self) -> dict[str, str]:
        return {"major": str(self.major), "minor": str(self.minor), "quant_type": str(int(self.quant_type)), "metric": self.metric.name, "pad": str(self.align_blocks).lower()}

    def reader_options(self) -> dict[str, str]:
        return {"verify": str(self.verify).lower()}
