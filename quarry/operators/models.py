"""Models as columns: loaded once a worker, called in batches of rows of like length, cut, repeated on failure, with a null where a row fails for good.

`load` is a function that gives a model, a callable from a list of inputs to a list of results; it is shipped to the workers. What comes out fits where the operators
take hooks: `answering.rerank`, `answering.answer`, `functions.text.sentiment`, `extract.signals`. As they go on to the next backend at a null, so does a row whose model fails.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

BATCH, MOST, TRIES = 16, 512, 2
_held: dict[str, object] = {}


def _model(key: str, load: Callable) -> Callable:
    """The worker's own model, loaded at its first use."""
    if key not in _held:
        _held[key] = load()
    return _held[key]


def _shortened(text: str, most: int) -> str:
    """The first `most` words."""
    words = text.split(None, most)
    return text if len(words) <= most else " ".join(words[:most])


def in_batches(model: Callable, inputs: list, batch: int = BATCH, tries: int = TRIES) -> list[tuple[object, str | None]]:
    """(result, error) of each input. Inputs of like length share a batch; a batch that fails again is called row by row."""
    out: list[tuple[object, str | None]] = [(None, None)] * len(inputs)
    order = sorted(range(len(inputs)), key=lambda i: len(str(inputs[i])))

    def call(rows: list[int], turns: int) -> str | None:
        error = None
        for _ in range(turns):
            try:
                got = model([inputs[i] for i in rows])
                if len(got) != len(rows):
                    raise ValueError(f"{len(got)} results for {len(rows)} inputs")
            except Exception as e:  # noqa: BLE001  whatever a model fails with belongs to its rows
                error = f"{type(e).__name__}: {e}"
                continue
            for i, x in zip(rows, got, strict=True):
                out[i] = (x, None)
            return None
        return error

    for a in range(0, len(order), batch):
        rows = order[a : a + batch]
        error = call(rows, tries)
        if error and len(rows) > 1:
            for i in rows:
                if error := call([i], 1):
                    out[i] = (None, error)
        elif error:
            out[rows[0]] = (None, error)
    return out


def column(load: Callable, kind: str, most: int = MOST, batch: int = BATCH, tries: int = TRIES) -> Callable[..., Column]:
    """A function of one or more text columns to struct<value, error>; a row with a null text is not asked about. Only the last text is cut."""
    key = uuid.uuid4().hex

    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = _model(key, load)
        for part in parts:
            rows = list(part.itertuples(index=False, name=None))
            asked = [i for i, r in enumerate(rows) if not any(pd.isna(x) for x in r)]
            inputs = [(*rows[i][:-1], _shortened(rows[i][-1], most)) for i in asked]
            got = dict(zip(asked, in_batches(model, [x[0] if len(x) == 1 else x for x in inputs], batch, tries), strict=True))
            yield pd.DataFrame([got.get(i, (None, None)) for i in range(len(rows))], columns=["value", "error"]).astype(object)

    return lambda *texts: run(F.struct(*[t.alias(f"t{i}") for i, t in enumerate(texts)]))


def scorer(load: Callable, **settings) -> Callable[[Column, Column], Column]:
    """Logits of (question, passage) for `answering.rerank`."""
    ask = column(load, "double", **settings)
    return lambda question, passage: ask(question, passage)["value"]


def generator(load: Callable, **settings) -> Callable[[Column, Column], Column]:
    """Answers to (question, context) for `answering.answer`; the context is cut."""
    ask = column(load, "string", **settings)
    return lambda question, context: ask(question, context)["value"]


def extractor(load: Callable, **settings) -> Callable[[Column], Column]:
    """Replies to a text for `extract.signals`."""
    ask = column(load, "string", **settings)
    return lambda text: ask(text)["value"]


def sentence_scores(load: Callable, most: int = MOST, batch: int = BATCH, tries: int = TRIES) -> Callable[[Column], Column]:
    """Scores (positive, negative, neutral) of each sentence of an array for `functions.text.sentiment`; null where any fails. Sentences of many rows share batches."""
    key = uuid.uuid4().hex

    @F.pandas_udf("array<struct<positive:double,negative:double,neutral:double>>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = _model(key, load)
        for part in parts:
            found = [None if x is None else list(x) for x in part]
            got = iter(in_batches(model, [_shortened(s, most) for x in found if x is not None for s in x], batch, tries))
            out = []
            for x in found:
                scores = None if x is None else [next(got) for _ in x]
                out.append(None if scores is None or any(e for _, e in scores) else [dict(zip(("positive", "negative", "neutral"), v, strict=True)) for v, _ in scores])
            yield pd.Series(out, dtype=object)

    return run
