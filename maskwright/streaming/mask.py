"""A streaming masker: chunks in, masked chunks out, token numbers kept per document across micro-batches."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame

from maskwright import constants as C

OUT = "doc_id string, chunk_ix int, masked string"
STATE = "mapping string"


def mask_stream(chunks: DataFrame, enabled: tuple[str, ...] = C.DEFAULT, namespace: str = "", despaced: bool = True) -> DataFrame:
    """``chunks`` (doc_id string, chunk_ix int, text string), streaming: each is masked with its document's mapping so far."""

    def step(key, batches, state):
        from maskwright.functions.mapping import Mapping

        before = json.loads(state.get[0]) if state.exists else None
        m = Mapping(enabled, previous=before, namespace=namespace, despaced=despaced)
        for surface, token in (before or {}).get("original_to_token", {}).items():
            m.register(surface, before["token_categories"][token])
        for batch in batches:
            batch = batch.sort_values("chunk_ix")
            for t in batch["text"]:
                m.discover(t or "")
            yield pd.DataFrame({"doc_id": [key[0]] * len(batch), "chunk_ix": batch["chunk_ix"].to_list(), "masked": [m.mask(t or "") for t in batch["text"]]})
        state.update((json.dumps(m.export(), ensure_ascii=False),))

    return chunks.groupBy("doc_id").applyInPandasWithState(step, OUT, STATE, "append", "NoTimeout")
