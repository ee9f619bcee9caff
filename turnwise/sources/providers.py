"""Model stages as replaceable providers over Arrow batches, with deterministic stand-ins.

A provider is made once per Python worker by its factory and kept; it takes and gives plain rows.  Errors stay with
their row (column ``error``), so that one bad file doesn't end the job.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame


class Provider(Protocol):
    """Rows of a result for one input row."""

    def __call__(self, row: dict) -> list[dict]: ...


_made: dict[str, Provider] = {}


def provided(df: DataFrame, name: str, factory: Callable[[], Provider], schema: str) -> DataFrame:
    """``factory``'s provider on every row of ``df``; ``schema`` is that of its rows, ``error string`` is added."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        provider = _made.get(name)
        if provider is None:
            provider = _made[name] = factory()
        for batch in batches:
            rows = []
            for row in batch.to_dict("records"):
                try:
                    rows += [r | {"error": None} for r in provider(row)]
                except Exception as e:
                    rows.append({k: v for k, v in row.items()} | {"error": f"{type(e).__name__}: {e}"})
            columns = [c.strip().split(" ")[0] for c in schema.split(",")] + ["error"]
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return df.mapInPandas(run, f"{schema}, error string")


def transcoder() -> Provider:
    """A stand-in for audio conversion: the digest of the content, at 16 kHz mono."""

    def convert(row: dict) -> list[dict]:
        content = row["content"]
        if not content:
            raise ValueError("empty file")
        return [{"path": row["path"], "sample_rate": 16_000, "channels": 1, "digest": hashlib.sha256(bytes(content)).hexdigest()}]

    return convert


def voice_activity(frames: int = 50) -> Callable[[], Provider]:
    """A stand-in for a voice activity model: frame scores from a digest of the recording's number."""

    def make() -> Provider:
        def scores(row: dict) -> list[dict]:
            seed = hashlib.sha256(str(row["rec_id"]).encode()).digest()
            return [{"rec_id": row["rec_id"], "frame_idx": i, "p": seed[i % 32] / 255.0} for i in range(frames)]

        return scores

    return make


def corrector() -> Provider:
    """A stand-in for a language model's correction: blanks normalised, a final stop."""

    def correct(row: dict) -> list[dict]:
        text = " ".join((row["text"] or "").split())
        return [{"doc_id": row["doc_id"], "text": text if text.endswith((".", "!", "?")) or not text else text + "."}]

    return correct


def place_finder() -> Callable[[str], list[tuple[int, int, str]]]:
    """A stand-in for a model that looks masked texts through: capitalised words after a preposition, as places."""
    pattern = re.compile(r"(?<!\w)(?:à|in|at|near)\s+([A-ZÀ-Þ][\w’'-]+)")
    return lambda window: [(*m.span(1), "LOC") for m in pattern.finditer(window)]
