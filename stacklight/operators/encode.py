"""From token vectors to the vectors of works. The encoder itself, a function from texts to token vectors, is injected: no model
is part of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import build_text
from .merge import EMBEDDER_VERSION
from .vectors import normalize


def pooled(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Unit vectors (texts, dims) from token vectors (texts, tokens, dims): the mean over the tokens that the mask (texts, tokens)
    counts. A text without tokens gives a zero vector."""
    m = mask[:, :, None].astype(np.float64)
    mean = (hidden * m).sum(1) / np.clip(m.sum(1), 1e-9, None)
    return (mean / np.clip(np.linalg.norm(mean, axis=1, keepdims=True), 1e-12, None)).astype(np.float32)


def pooled_column(hidden: Column, mask: Column) -> Column:
    """The same of one text as a column: hidden, an array of token vectors, mask, an array of 0 and 1."""
    kept = F.filter(F.zip_with(hidden, mask, lambda h, m: F.when(m == 1, h)), lambda h: h.isNotNull())
    zero = F.transform(F.get(hidden, F.lit(0)), lambda _: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, h: F.zip_with(acc, h, lambda a, b: a + b.cast("double")))
    return normalize(F.transform(total, lambda x: x / F.greatest(F.size(kept).cast("double"), F.lit(1e-9))))


def averaged(core: Column, description: Column) -> Column:
    """The unit vector of a work: its core's, or the renormalised mean of its core's and its description's where it has one."""
    return F.when(description.isNull(), core).otherwise(normalize(F.zip_with(core, description, lambda a, b: (a + b) / 2)))


def encode_works(works: DataFrame, load: Callable[[], Callable[[list[str]], tuple[np.ndarray, np.ndarray]]], model: str, batch: int = 64) -> DataFrame:
    """works (id, title, title_alternate, subjects, summary, contents, content_hash) -> work_id, vector, dimensions, model,
    embedder_version, source_hash, is_title_only: a row for merge_by_key(). load is called once in each worker and gives a function
    from texts to (token vectors, mask); core and description are encoded apart and averaged."""
    t = build_text(F.col("title"), F.col("title_alternate"), F.col("subjects"), F.col("summary"), F.col("contents"))
    rows = works.select("id", "content_hash", t.alias("t")).select("id", "content_hash", "t.*")

    def run(batches: Iterator[pa.RecordBatch]):
        encode = load()
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                b = whole.slice(lo, batch)
                core = pooled(*encode(b.column("core").to_pylist())).astype(np.float64)
                texts = b.column("description").to_pylist()
                at = [i for i, x in enumerate(texts) if x]
                if at:
                    core[at] = (core[at] + pooled(*encode([texts[i] for i in at]))) / 2
                    norm = np.linalg.norm(core, axis=1, keepdims=True)
                    core = core / np.where(norm == 0, 1, norm)
                vectors = pa.array(core.astype(np.float32).tolist(), pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([b.column("id"), vectors, b.column("content_hash"), b.column("is_title_only")], names=["work_id", "vector", "source_hash", "is_title_only"])

    out = rows.mapInArrow(run, f"work_id {works.schema['id'].dataType.simpleString()}, vector array<float>, source_hash string, is_title_only boolean")
    return out.select("work_id", "vector", F.size("vector").alias("dimensions"), F.lit(model).alias("model"), F.lit(EMBEDDER_VERSION).alias("embedder_version"), "source_hash", "is_title_only")
