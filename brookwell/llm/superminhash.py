"""SuperMinHash near-dedup: signatures of correlated permutation ranks, banding, verification, union-find.

1. Every shingle of a text (four words, A-Z lower-cased) draws a permutation of the
   signature's positions, by Fisher-Yates steps from its hash. In step j it offers
   ``j + u`` (u a fresh number in [0, 1)) to the position it is dealt; a position
   keeps the least offer. A shingle so reaches every position once and offers ranks
   0, 1, 2 and so on: the positions are correlated, and the share of equal positions
   estimates the similarity with less variance than independent min-hashes do.
2. Steps are taken for all shingles of a batch at once. A text stops as soon as all
   its positions hold less than the next step's least offer, so a text of many
   shingles takes two or three steps and not one for each position.
3. Bands of the signature are shuffled, candidates are verified on full shingle sets
   in blocks, and the true links are joined to components (``nearjoin``): a task
   returns a spanning forest of its links, and forests are merged by least members.

Defined cases: a text without words (null, empty, blank) has an empty set, is linked
to nothing and is its own component; one to three words count as a single shingle;
repeated rows and equal texts meet in one class before anything is compared; a null
id can be in a component, but names it only if no other id is in it; such a row is
kept only if the component has no other id; a very long text is one set of shingles;
an empty table gives an empty one; other columns are not looked at.
"""

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brookwell.llm import nearjoin
from brookwell.llm import wordhash as wh

U64 = np.uint64
SHINGLE = 4
#: Shingles whose permutations are in memory at a time.
AT_ONCE = 1 << 15


def _offer(best: np.ndarray, elements: np.ndarray, owner: np.ndarray, length: int) -> None:
    """Lower ``best`` (texts x positions) by all offers of the elements that can still win."""
    slots = None
    for j in range(length):
        drawn = wh.mix(elements + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        offers = j + (drawn >> U64(11)).astype(np.float64) * 2.0**-53
        picked = j + (((wh.mix(drawn ^ U64(wh.OTHER_KEY)) >> U64(32)) * U64(length - j)) >> U64(32)).astype(np.int64)
        if slots is None:
            position, first = picked, picked
        else:
            rows = np.arange(len(elements))
            position = slots[rows, picked]
            slots[rows, picked] = slots[:, j]
        np.minimum.at(best.reshape(-1), owner * length + position, offers)
        texts, at = np.unique(owner, return_inverse=True)
        open_ = (best[texts].max(axis=1) >= j + 1)[at]
        if not open_.any():
            return
        elements, owner = elements[open_], owner[open_]
        if slots is None:
            slots = np.tile(np.arange(length, dtype=np.int16), (len(elements), 1))
            slots[np.arange(len(elements)), first[open_]] = 0
        elif not open_.all():
            slots = slots[open_]


def signatures(sets: list[np.ndarray], length: int) -> np.ndarray:
    """One row of ``length`` ranks for each set of 64-bit hashes; an empty set has infinite ranks."""
    best = np.full((len(sets), length), np.inf)
    elements = np.concatenate(sets) if sets else np.zeros(0, U64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    for at in range(0, len(elements), AT_ONCE):
        _offer(best, elements[at : at + AT_ONCE], owner[at : at + AT_ONCE], length)
    return best


def sign(sets: list[np.ndarray], bands: int, rows: int) -> list[np.ndarray]:
    """The band hashes of each set."""
    ranks = wh.mix(signatures(sets, bands * rows).view(U64)).reshape(len(sets), bands, rows)
    out = np.zeros((len(sets), bands), U64)
    for i in range(rows):
        out = wh.mix(out + ranks[:, :, i])
    return list(out)


def near_duplicates(docs: DataFrame, threshold: float = 0.8, recall: float = 0.9999, most_hashes: int = 128, id_col: str = "doc_id", text_col: str = "text", **blocks: int) -> DataFrame:
    """One row per document: id, n_shingles, component_id (least id reachable over links, its own included), kept (the id is the component's).

    ``blocks`` are the bounds of the verification's blocks, as of ``nearjoin.near_duplicates``; results don't depend on them.
    """
    found = nearjoin.near_duplicates(docs, threshold, recall, most_hashes, id_col=id_col, text_col=text_col, width=SHINGLE, ascii_only=True, sign_sets=sign, **blocks)
    return found.select(id_col, "n_shingles", F.col("class_id").alias("component_id"), F.col(id_col).eqNullSafe(F.col("class_id")).alias("kept"))
