"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

Texts are signed with BagMinHash, banded, and verified on the exact multisets: two texts are
linked if their weighted Jaccard similarity is at least ``similarity``. How classes come from
signatures is in :mod:`hirelake.llm.near_classes`. A pair at exactly 0.8 is missed by the bands with
a chance below 1e-5, and by the comparison of signatures before the exact test with one below 1e-5.

Defined cases: null text is empty; texts that are equal are one class, the empty ones too; a text
without words is only like texts equal to it; one with fewer than five words has one shingle; a very
long text is signed whole, in windows of bounded memory; a class is named by its least doc_id (null
if it has none), and of documents that tie the one with the least doc_id (nulls last), then text key,
stays; an empty table gives an empty result; other columns, whatever their names, are ignored, or
kept by :func:`drop_near_duplicates`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import near_classes
from hirelake.llm.bagminhash import SIZE, bags, signatures, weighted_jaccard
from hirelake.llm.common import materialise, spread_copies, table
from hirelake.llm.wordhash import U, mix, shingles

SIMILARITY = 0.8
SHINGLE_WORDS = 5
BANDS, ROWS = 30, 5
#: Signatures of 256 must agree in the threshold less this share for exact verification: 4.8
#: standard deviations.
AGREEMENT_SLACK = 0.12


@dataclass(frozen=True)
class ShingleBags:
    """Weighted Jaccard similarity of the multisets of runs of words."""

    similarity: float = SIMILARITY
    words: int = SHINGLE_WORDS
    dtype = np.uint16
    size = SIZE

    @property
    def least_agreement(self) -> float:
        return self.similarity - AGREEMENT_SLACK

    def sign(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        elements, owner, weight = bags(*shingles(texts, self.words))
        ident = signatures(elements, owner, weight, len(texts))
        has = np.bincount(owner, minlength=len(texts)) > 0
        kept = ident[:, : BANDS * ROWS].reshape(len(texts), BANDS, ROWS)
        keys = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=U)), (len(texts), BANDS)).copy()
        for r in range(ROWS):
            keys = mix(keys + kept[:, :, r])
        return has, (ident >> U(48)).astype(np.uint16), keys

    def prepare(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        elements, owner, weight = bags(*shingles(texts, self.words))
        edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        return [(elements[i:j], weight[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]

    def alike(self, a, b) -> bool:
        return weighted_jaccard(a, b) >= self.similarity


def classify_documents(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    return near_classes.classify_documents(docs, ShingleBags(similarity, words))


def drop_near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    return near_classes.drop_near_duplicates(docs, ShingleBags(similarity, words))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document: its class (least doc_id), the class's size and whether it is the one that stays."""
    members = materialise(classify_documents(table(spark, sf_dir, "documents")), "members")
    return spread_copies(members.select("doc_id", "class_id", "class_size", "kept", "copies"))
