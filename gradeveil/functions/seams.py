"""Places for models: recognisers, detectors and reasoners are plain Python callables, and stubs that find nothing stand
in for them. A model is loaded once per worker, runs over Arrow batches, and sees each distinct text only once.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITIES = "array<struct<entity:string,score:double>>"
LINES = "array<struct<text:string,confidence:double,x:double,y:double,width:double,height:double>>"
BOXES = "array<struct<label:string,score:double,x:double,y:double,width:double,height:double>>"
ANSWER = "struct<type:string,elementId:string,text:string,option:string,direction:string,amount:int,milliseconds:int,message:string>"


@dataclass(frozen=True)
class Perception:
    """load: called once per worker; what it returns has ocr(png), entities(text) and barcodes(png)."""

    load: Callable[[], object]


class NoPerception:
    def ocr(self, png: bytes) -> list[dict]:
        return []

    def entities(self, text: str) -> list[dict]:
        return []

    def barcodes(self, png: bytes) -> list[dict]:
        return []


@dataclass(frozen=True)
class Manifest:
    """What a model is and how it may be used."""

    name: str
    digest: str
    inputs: tuple[str, ...] = ("text",)
    actions: tuple[str, ...] = field(default_factory=tuple)


class NoReasoner:
    manifest = Manifest("none", "")

    def ready(self) -> bool:
        return False

    def reason(self, observation: str) -> dict | None:
        return None


def _mapped(load: Callable[[], object], method: str, kind: str) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for values in batches:
            yield pd.Series([None if v is None else getattr(model, method)(v) for v in values], dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, kind)


def recognised_entities(df: DataFrame, text: str, load: Callable[[], object] = NoPerception, out: str = "entities") -> DataFrame:
    """df with the entities in each text. Each distinct text goes through the model once; null texts give null."""
    distinct = df.select(F.col(text).alias("__text")).where("__text is not null").distinct()
    found = distinct.withColumn(out, _mapped(load, "entities", ENTITIES)(F.col("__text")))
    return df.join(found, F.col(text) == F.col("__text"), "left").drop("__text")


def recognised_lines(df: DataFrame, png: str, load: Callable[[], object] = NoPerception, out: str = "lines") -> DataFrame:
    return df.withColumn(out, _mapped(load, "ocr", LINES)(F.col(png)))


def detected_boxes(df: DataFrame, png: str, load: Callable[[], object], out: str = "boxes") -> DataFrame:
    """load: returns something with detect(png)."""
    return df.withColumn(out, _mapped(load, "detect", BOXES)(F.col(png)))


def reasoned(df: DataFrame, observation: str, load: Callable[[], object] = NoReasoner, out: str = "action") -> DataFrame:
    """df with the model's action for each observation (JSON); null where it is not ready or has none."""

    class Ready:
        def __init__(self) -> None:
            self.model = load()

        def answer(self, value: str) -> str | None:
            action = self.model.reason(value) if self.model.ready() else None
            return None if action is None else json.dumps(action)

    return df.withColumn(out, F.from_json(_mapped(Ready, "answer", "string")(F.col(observation)), ANSWER))


def letterbox(picture: np.ndarray, size: int, fill: int = 114) -> tuple[np.ndarray, float, float, float]:
    """A picture (height, width, 3) scaled into a square of `size`, as channels by rows by columns from 0 to 1, and the
    scale and the padding left and above."""
    height, width = picture.shape[:2]
    scale = min(size / width, size / height)
    w, h = max(1, round(width * scale)), max(1, round(height * scale))
    rows, columns = (np.minimum((np.arange(n) + 0.5) / scale, m - 1).astype(int) for n, m in ((h, height), (w, width)))
    out = np.full((size, size, 3), fill, np.float32)
    left, top = (size - w) // 2, (size - h) // 2
    out[top : top + h, left : left + w] = picture[rows][:, columns, :3]
    return (out / 255.0).transpose(2, 0, 1), scale, float(left), float(top)


def normalised(tensor: np.ndarray, mean: tuple[float, ...], deviation: tuple[float, ...]) -> np.ndarray:
    return (tensor - np.array(mean, np.float32)[:, None, None]) / np.array(deviation, np.float32)[:, None, None]
