"""The column catalogue: name -> (inputs, builder, stage). Users may add their own."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column

BASE = {"open", "high", "low", "close", "volume", "bar_idx", "ts"}


@dataclass(frozen=True)
class Feature:
    """`stage` is one of

    column    a Column over earlier columns (windows allowed), computed per chunk
    scan      y = decay * y + gain * input over the whole series, with block carries
    array     a NumPy kernel over one chunk's arrays, after the arrays it depends on
    """

    name: str
    deps: tuple[str, ...]
    build: Callable[[], Column] | None = None
    stage: str = "column"
    kernel: tuple = ()
    lookback: int = 0
    causal: bool = True


@dataclass
class Catalogue:
    features: dict[str, Feature] = field(default_factory=dict)

    def column(self, name, deps, build, lookback=0, causal=True):
        self.features[name] = Feature(name, tuple(deps), build, "column", lookback=lookback, causal=causal)

    def array(self, name, fn, deps, *args, lookback=0, causal=True):
        self.features[name] = Feature(name, tuple(deps), None, "array", (fn, args), lookback, causal)

    def scan(self, name, source, decay, gain, first):
        """y = decay * y + gain * source, started with first * source on a series' first bar."""
        self.features[name] = Feature(name, (source,), None, "scan", (decay, gain, first))

    def closure(self, names, known=()) -> dict[str, Feature]:
        """The requested features and everything they need that is not known."""
        out: dict[str, Feature] = {}
        todo = list(names)
        while todo:
            n = todo.pop()
            if n in BASE or n in known or n in out:
                continue
            if n not in self.features:
                raise KeyError(f"unknown feature {n!r}")
            out[n] = self.features[n]
            todo.extend(out[n].deps)
        return out


USER_FEATURES: dict[str, tuple] = {}


def register_feature(name: str, deps, builder: Callable[[], Column], lookback: int = 0) -> None:
    """Adds a user column; `builder` returns a Column over `deps` and chunk windows."""
    USER_FEATURES[name] = (tuple(deps), builder, lookback)
