"""A registry of grid functions by name: the place where models would plug in.

A backend maps batches of grids to batches of grids. `auto` takes the first of an ordered list that loads; a stated
name that does not load is an error. Neural models, codecs and devices are out of scope and raise one.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

Backend = Callable[[np.ndarray], np.ndarray]
_FACTORIES: dict[str, Callable[[], Backend]] = {}
OUT_OF_SCOPE = ("depth-model", "flow-model", "inpaint-model", "upscale-model", "video-codec", "audio-device")


def register(name: str, factory: Callable[[], Backend]) -> None:
    _FACTORIES[name] = factory


def create(name: str, candidates: Sequence[str] = ()) -> Backend:
    if name in OUT_OF_SCOPE:
        raise NotImplementedError(f"{name} is out of scope")
    if name != "auto":
        if name not in _FACTORIES:
            raise KeyError(f"no backend {name}")
        return _FACTORIES[name]()
    problems = []
    for candidate in candidates:
        try:
            return create(candidate)
        except Exception as e:  # any candidate may fail to load, for its own reasons
            problems.append(f"{candidate}: {e}")
    raise RuntimeError("no backend loads: " + "; ".join(problems))


def applied(column: Column, name: str, candidates: Sequence[str] = ()) -> Column:
    """The backend's grids for an array<float> column, by Arrow batches; it is created once per batch iterator."""

    @F.pandas_udf("array<float>")
    def run(values: pd.Series) -> pd.Series:
        return pd.Series(list(create(name, candidates)(np.stack(values.to_numpy()).astype(np.float32))))

    return run(column)


register("identity", lambda: lambda grids: grids)
register("clip", lambda: lambda grids: np.clip(grids, 0.02, 0.98))
