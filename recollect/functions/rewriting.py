"""Rewriting of texts by a function that may fail, in batches of an Arrow iterator."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

#: ``text`` of a call that went well, else ``error``.
RESULT = "struct<text:string,error:string>"
_ARROW = pa.struct([("text", pa.string()), ("error", pa.string())])
#: Prompts of one call.
BATCH = 16


def rewriter(call: Callable[[Sequence[str]], Sequence[str | None]], batch: int = BATCH) -> Callable[[Column], Column]:
    """Column function prompt -> ``RESULT``.

    ``call`` gets up to ``batch`` prompts and returns as many texts. Where it fails
    or returns another number, its prompts are sent one by one, and only those that
    fail again have an error. A NULL prompt is not sent; a NULL answer is ''. Whatever
    ``call`` keeps in its closure is made once per task.
    """

    def one(prompt: str) -> dict:
        try:
            (text,) = call([prompt])
            return {"text": text or "", "error": None}
        except Exception as e:  # a failing model must not fail the job
            return {"text": None, "error": f"{type(e).__name__}: {e}"}

    def some(prompts: list[str]) -> list[dict]:
        try:
            texts = list(call(prompts))
        except Exception:
            texts = []
        if len(texts) != len(prompts):
            return [one(p) for p in prompts]
        return [{"text": t or "", "error": None} for t in texts]

    @arrow_udf(RESULT)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            prompts = values.to_pylist()
            sent = [i for i, p in enumerate(prompts) if p is not None]
            out: list[dict | None] = [None] * len(prompts)
            for at in range(0, len(sent), batch):
                part = sent[at: at + batch]
                for i, result in zip(part, some([prompts[i] for i in part])):
                    out[i] = result
            yield pa.array(out, _ARROW)

    # Only so that the optimizer never sends a prompt twice.
    run = run.asNondeterministic()
    return lambda prompt: run(prompt)
