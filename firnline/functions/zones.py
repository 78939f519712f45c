"""Zone schemes: how a layer's pixel values fall into the zones of a query axis.

A scheme lists its zones and builds the Column of a pixel's ordinal, -1 where it is in no zone. Nothing runs in Python
for a pixel: ordinals are whole-stage-compiled expressions.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping
from dataclasses import dataclass, replace
from typing import Any, ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from firnline.errors import QueryError, ZoneConfigError

FEET_PER_METRE = 3.28084


@dataclass(frozen=True)
class Zone:
    ordinal: int
    kind: str
    label: str
    low: float | int | None = None
    high: float | int | None = None
    unit: str | None = None
    code: int | None = None
    key: str | None = None
    threshold: float | None = None
    side: str | None = None

    def columns(self, layer: str) -> dict[str, str]:
        """Header and text of this zone's columns in a CSV file."""
        if self.kind == "band":
            unit = f"_{self.unit}" if self.unit else ""
            return {f"{layer}_min{unit}": str(self.low), f"{layer}_max{unit}": str(self.high)}
        if self.kind == "threshold":
            return {f"{layer}_side": self.label, f"{layer}_threshold_{self.unit}": f"{self.threshold:g}"}
        return {layer: self.key or ""}

    def reference(self, layer: str) -> dict[str, Any]:
        """The zone as JSON refers to it."""
        if self.kind == "band":
            return {"type": "band", "layer": layer, "label": self.label, "min": self.low, "max": self.high, "unit": self.unit}
        if self.kind == "threshold":
            return {"type": "threshold", "layer": layer, "label": self.label, "side": self.side, "threshold": self.threshold, "unit": self.unit}
        return {"type": "class", "layer": layer, "label": self.label, "key": self.key}


def tidy(x: float) -> float | int:
    """x to six decimals, as an int where it is whole."""
    x = round(x, 6)
    return int(x) if x == int(x) else x


class Scheme(ABC):
    """parameter: the one thing a query or dataset may set, held in the field `setting`; None if there is nothing to set."""

    parameter: str | None = None
    setting: ClassVar[str | None] = None
    number: ClassVar[type] = int
    noun: ClassVar[str] = "value"

    @abstractmethod
    def zones(self) -> list[Zone]: ...

    @abstractmethod
    def ordinal(self, value: Column) -> Column: ...

    @abstractmethod
    def described(self) -> dict[str, Any]: ...

    def set_to(self, value: float) -> Scheme:
        if self.setting is None:
            raise QueryError("this zone layer has nothing to set")
        return replace(self, **{self.setting: self.number(value)})

    def configured(self, settings: Mapping[str, float] | None) -> Scheme:
        """The scheme with a dataset's settings; one that it does not have is an error in the dataset."""
        if not settings:
            return self
        if self.parameter is None:
            raise ZoneConfigError(f"this zone layer takes no parameters, but is given {', '.join(sorted(settings))}")
        if set(settings) != {self.parameter}:
            raise ZoneConfigError(f"this zone layer is set by {self.parameter!r}, but is given {', '.join(sorted(settings))}")
        return self.set_to(settings[self.parameter])

    def parsed(self, layer: str, text: str) -> float | int:
        try:
            return self.number(text)
        except ValueError:
            raise QueryError(f"the {self.noun} of zone {layer!r} must be {'an integer' if self.number is int else 'a number'}, not {text!r}") from None

    def frame(self, spark: SparkSession, axis: str) -> DataFrame:
        """The zones as rows."""
        rows = [(axis, z.ordinal, z.kind, z.label, None if z.low is None else float(z.low), None if z.high is None else float(z.high), z.unit, z.code, z.key, z.threshold, z.side) for z in self.zones()]
        return spark.createDataFrame(rows, "axis string, ordinal int, kind string, label string, low double, high double, unit string, code int, key string, threshold double, side string")


def _outside(value: Column, scaled: Column, nodata: float) -> Column:
    return value.isNull() | (value == F.lit(nodata)) | F.isnan(scaled)


@dataclass(frozen=True)
class Bands(Scheme):
    """Bands [i step, (i + 1) step) aligned to 0 that cover low to high; pixels are scaled to the bands' unit first."""

    low: float
    high: float
    step: int
    unit: str
    scale: float
    nodata: float
    parameter: str | None = "band_step_ft"
    setting: ClassVar[str] = "step"
    noun: ClassVar[str] = "band step"

    def __post_init__(self) -> None:
        if not isinstance(self.step, int) or isinstance(self.step, bool) or self.step <= 0:
            raise QueryError(f"the band step must be a positive integer, not {self.step!r}")

    @property
    def _first(self) -> int:
        return int(self.low // self.step)

    @property
    def _count(self) -> int:
        return int(self.high // self.step) + 1 - self._first

    def zones(self) -> list[Zone]:
        edges = [(self._first + k) * self.step for k in range(self._count + 1)]
        return [Zone(k, "band", f"{a}-{b} {self.unit}", a, b, self.unit) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]

    def ordinal(self, value: Column) -> Column:
        x = value.cast("double") * F.lit(self.scale)
        step = F.lit(float(self.step))
        guess = F.floor(x / step)
        band = guess - F.when(x < guess * step, 1).otherwise(0) + F.when(x >= (guess + 1) * step, 1).otherwise(0)  # the division may round over an edge
        at = band - self._first
        return F.when(_outside(value, x, self.nodata) | (at < 0) | (at >= self._count), -1).otherwise(at).cast("int")

    def described(self) -> dict[str, Any]:
        zones = self.zones()
        return {"kind": "banded", "param": self.parameter, "default": self.step, "unit": self.unit, "min": zones[0].low, "max": zones[-1].high}


@dataclass(frozen=True)
class Buckets(Scheme):
    """`count` even buckets of the closed range low to high; the top edge belongs to the last one."""

    low: float
    high: float
    count: int
    nodata: float
    parameter: str | None = "buckets"
    setting: ClassVar[str] = "count"
    noun: ClassVar[str] = "bucket count"

    def __post_init__(self) -> None:
        if not isinstance(self.count, int) or isinstance(self.count, bool) or self.count < 1:
            raise QueryError(f"the bucket count must be a positive integer, not {self.count!r}")

    def edges(self) -> list[float | int]:
        width = (self.high - self.low) / self.count
        return [tidy(self.low + k * width) for k in range(self.count + 1)]

    def zones(self) -> list[Zone]:
        edges = self.edges()
        return [Zone(k, "band", f"{a} to {b}", a, b) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]

    def ordinal(self, value: Column) -> Column:
        x = value.cast("double")
        edges = [float(e) for e in self.edges()]

        def search(first: int, last: int) -> Column:
            """Which of the buckets first to last x is in, if it is in one of them."""
            if first == last:
                return F.lit(first)
            middle = (first + last + 1) // 2
            return F.when(x < F.lit(edges[middle]), search(first, middle - 1)).otherwise(search(middle, last))

        inside = (x >= F.lit(edges[0])) & (x <= F.lit(edges[-1]))
        return F.when(_outside(value, x, self.nodata) | ~inside, -1).otherwise(search(0, self.count - 1)).cast("int")

    def described(self) -> dict[str, Any]:
        edges = self.edges()
        return {"kind": "bucketed", "param": self.parameter, "default": self.count, "min": edges[0], "max": edges[-1]}


@dataclass(frozen=True)
class Split(Scheme):
    """Two zones: 0 below the threshold, 1 from it on. The range is told, not enforced; NaN is below."""

    threshold: float
    low: float
    high: float
    unit: str
    scale: float
    nodata: float
    below: str
    above: str
    parameter: str | None = "threshold_pct"
    setting: ClassVar[str] = "threshold"
    number: ClassVar[type] = float
    noun: ClassVar[str] = "threshold"

    def zones(self) -> list[Zone]:
        t = float(self.threshold)
        return [Zone(k, "threshold", label, unit=self.unit, threshold=t, side=side) for k, (label, side) in enumerate(((self.below, "below"), (self.above, "above")))]

    def ordinal(self, value: Column) -> Column:
        x = value.cast("double") * F.lit(float(self.scale))
        return F.when(value.isNull() | (value == F.lit(self.nodata)), -1).when(F.isnan(x), 0).when(x >= F.lit(float(self.threshold)), 1).otherwise(0).cast("int")

    def described(self) -> dict[str, Any]:
        return {"kind": "threshold", "param": self.parameter, "default": float(self.threshold), "unit": self.unit, "min": tidy(self.low), "max": tidy(self.high)}


@dataclass(frozen=True)
class Classes(Scheme):
    """Discrete classes, in the order of their zones: (code in the pixels, key, label)."""

    classes: tuple[tuple[int, str, str], ...]

    def zones(self) -> list[Zone]:
        return [Zone(k, "class", label, code=code, key=key) for k, (code, key, label) in enumerate(self.classes)]

    def ordinal(self, value: Column) -> Column:
        out = F.when(value.isNull(), -1)
        for k, (code, _, _) in enumerate(self.classes):
            out = out.when(value == F.lit(code), k)
        return out.otherwise(-1).cast("int")

    def described(self) -> dict[str, Any]:
        return {"kind": "categorical", "classes": [{"key": key, "label": label} for _, key, label in self.classes]}


@dataclass(frozen=True)
class Layer:
    """A zone layer: where it comes from, its column in the zone pixels and its scheme."""

    provider: str
    name: str
    column: str
    scheme: Scheme

    @property
    def key(self) -> str:
        return f"{self.provider}.{self.name}"


_ASPECTS = ((0, "N", "North"), (1, "E", "East"), (2, "S", "South"), (3, "W", "West"), (4, "flat", "Flat"))


def registry(layers: list[Layer]) -> dict[str, Layer]:
    return {layer.key: layer for layer in layers}


#: The ranges, nodata codes and defaults of the six standard layers.
STANDARD_LAYERS = registry(
    [
        Layer("terrain", "elevation", "elevation", Bands(-100 * FEET_PER_METRE, 4500 * FEET_PER_METRE, 1000, "ft", FEET_PER_METRE, -9999)),
        Layer("terrain", "aspect", "aspect", Classes(_ASPECTS)),
        Layer("terrain", "northness", "northness", Buckets(-1.0, 1.0, 4, -9999)),
        Layer("terrain", "eastness", "eastness", Buckets(-1.0, 1.0, 4, -9999)),
        Layer("terrain", "aspect_entropy", "aspect_entropy", Split(0.5, 0, 1, "Hnorm", 1, -1, "high_signal", "low_signal", "entropy_threshold")),
        Layer("landcover", "forest_cover", "forest_cover", Split(50.0, 0, 100, "%", 1, 255, "unforested", "forested")),
    ]
)


@dataclass(frozen=True)
class Selection:
    layer: str
    value: float | int | None = None


def parse_selection(token: str, layers: Mapping[str, Layer] = STANDARD_LAYERS) -> Selection:
    """`LAYER` or `LAYER:PARAM=VALUE`."""
    name, colon, rest = token.partition(":")
    layer = _found(name, layers)
    if not colon:
        return Selection(name)
    parameter, equals, text = rest.partition("=")
    if not equals:
        raise QueryError(f"malformed zone {token!r}: write LAYER:PARAM=VALUE, as in terrain.elevation:band_step_ft=500")
    if layer.scheme.parameter is None:
        raise QueryError(f"zone layer {name!r} is categorical and has nothing to set")
    if parameter != layer.scheme.parameter:
        raise QueryError(f"zone layer {name!r} has no {parameter!r}; it is set by {layer.scheme.parameter!r}")
    return Selection(name, layer.scheme.parsed(name, text))


def _found(name: str, layers: Mapping[str, Layer]) -> Layer:
    if name not in layers:
        raise QueryError(f"unknown zone layer {name!r}; there are {', '.join(sorted(layers)) or 'none'}")
    return layers[name]


@dataclass(frozen=True)
class Axis:
    """A layer with the scheme that a query uses."""

    layer: Layer
    scheme: Scheme

    @property
    def ordinal(self) -> Column:
        return self.scheme.ordinal(F.col(self.layer.column))


def resolve_axis(selection: Selection, settings: Mapping[str, Mapping[str, float]] | None = None, layers: Mapping[str, Layer] = STANDARD_LAYERS) -> Axis:
    """The registered layer, with the dataset's settings, then the query's."""
    layer = _found(selection.layer, layers)
    try:
        scheme = layer.scheme.configured((settings or {}).get(layer.key))
    except ZoneConfigError as e:
        raise ZoneConfigError(f"zones[{layer.key!r}]: {e}") from e
    return Axis(layer, scheme if selection.value is None else scheme.set_to(selection.value))


def layers_frame(spark: SparkSession, layers: Mapping[str, Layer] = STANDARD_LAYERS) -> DataFrame:
    """What each layer offers: one row per layer, in order of key."""
    rows = [(k, d["kind"], d.get("param"), float(d["default"]) if "default" in d else None, d.get("unit"), float(d["min"]) if "min" in d else None, float(d["max"]) if "max" in d else None, [c["key"] for c in d.get("classes", [])]) for k in sorted(layers) for d in [layers[k].scheme.described()]]
    return spark.createDataFrame(rows, "layer string, kind string, param string, default double, unit string, low double, high double, classes array<string>")
