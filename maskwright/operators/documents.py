"""Whole documents through the rule engine: chunks in, masked chunks and mappings out (Arrow batches, one document a group)."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright import constants as C

MASKED = "doc_id string, chunk_ix int, masked string, mapping string, counts map<string,int>"


def deidentify(chunks: DataFrame, enabled: tuple[str, ...] = C.DEFAULT, labels: list[tuple[str, str]] = (), namespace: str = "", despaced: bool = True, accept_aliases: bool = False) -> DataFrame:
    """``chunks`` (doc_id string, chunk_ix int, text string) masked with one mapping per document.

    Labels that a document contains are registered first, then the rules run chunk by chunk. The chunks of
    one document, whose size the extraction limits bound, meet in one row; documents are independent.
    """
    docs = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("chunk_ix", "text"))).alias("chunks"))
    wanted = list(labels)

    def run(batches):
        from maskwright.functions.mapping import Mapping, relevant
        from maskwright.functions.matching import Scan, match_key

        known = Scan(match_key(t) for t, _ in wanted)
        for batch in batches:
            out = []
            for doc_id, parts in zip(batch["doc_id"], batch["chunks"]):
                texts = [(p["chunk_ix"], p["text"] or "") for p in parts]
                whole = "\n".join(t for _, t in texts)
                m = Mapping(enabled, relevant(wanted, whole, known), namespace=namespace, despaced=despaced)
                for _, t in texts:
                    m.discover(t)
                if accept_aliases:
                    for g in m.suggest(whole):
                        m.merge(g["canonical"], g["members"][1:])
                mapping = json.dumps(m.export(), ensure_ascii=False)
                out += [(doc_id, i, m.mask(t), mapping, m.counts()) for i, t in texts]
            yield pd.DataFrame(out, columns=["doc_id", "chunk_ix", "masked", "mapping", "counts"])

    return docs.mapInPandas(run, MASKED)


def restore_chunks(masked: DataFrame) -> DataFrame:
    """Adds ``restored`` to (…, masked, mapping)."""

    def run(batches):
        from maskwright.functions.mapping import restore

        for batch in batches:
            yield batch.assign(restored=[restore(t, json.loads(m)) for t, m in zip(batch["masked"], batch["mapping"])])

    return masked.mapInPandas(run, f"{MASKED}, restored string")
