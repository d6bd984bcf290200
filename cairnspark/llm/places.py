"""Sets of lines that travel to the texts, so that texts shuffle nowhere: Bloom filters of places, and exact cascades of them.

A place is (doc_id, text_key, line).  A filter takes BITS bits a place, in slots of SLOT bits that are built by a task each.
A cascade is exact for the places of a table: its first filter holds the set, the second those other places of the table
that pass the first, the third those of the set that pass the second, and so on until none passes; a place is in the set
if it passes an odd number of filters in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import materialise, mix
from .groups import dealt, numbers

#: Bits for each place, bits that a place sets, and bits of a slot (1 MiB).
BITS, PROBES, SLOT = 12, 4, 1 << 23
PLACE = ["doc_id", "text_key", "line"]
TYPES = "doc_id long, text_key long, line int"


def spots(docs: np.ndarray, keys: np.ndarray, lines: np.ndarray, level: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each place, and its bits there."""
    h = mix(docs.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % 2**64))
    h = mix(mix(h ^ keys.view(np.uint64)) + lines.astype(np.uint64))
    slot = (h >> np.uint64(32)) * np.uint64(slots) >> np.uint64(32)
    bits = np.stack([mix(h + np.uint64(j * 0xD1342543DE82EF95 % 2**64)) & np.uint64(SLOT - 1) for j in range(1, PROBES + 1)], axis=1)
    return slot.astype(np.int64), bits.astype(np.uint32)


def passes(filters: list[np.ndarray], docs: np.ndarray, keys: np.ndarray, lines: np.ndarray, first: int = 0) -> np.ndarray:
    """How many filters in a row each place passes; ``first`` is the level of the first."""
    out = np.zeros(len(docs), dtype=np.int64)
    at = np.arange(len(docs))
    for level, filter_ in enumerate(filters):
        slot, bits = spots(docs[at], keys[at], lines[at], level + first, len(filter_) * 8 // SLOT)
        byte, bit = slot[:, None] * (SLOT >> 3) + (bits >> np.uint32(3)), (bits & np.uint32(7)).astype(np.uint8)
        at = at[(filter_[byte] >> bit & 1).all(axis=1)]
        out[at] += 1
    return out


def arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))


def filled(group: pa.Table) -> pa.Table:
    bits = np.zeros(SLOT, dtype=bool)
    for value in group.column("postings"):
        bits[numbers(value, "<u4")] = True
    return pa.table({"range": group.column("range")[:1].cast(pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})


def filter_of(places: DataFrame, level: int = 0) -> np.ndarray:
    """The filter of the materialised ``places``."""
    slots = max(1, -(-places.count() * BITS // SLOT))

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot, bits = spots(*arrays(batch), level, slots)
            yield dealt(bits, slot)

    out = np.zeros((slots, SLOT >> 3), dtype=np.uint8)
    for row in places.select(*PLACE).mapInArrow(hits, "range int, postings binary").groupBy("range").applyInArrow(filled, "range int, bits binary").collect():
        out[row.range] = np.frombuffer(row.bits, dtype=np.uint8)
    return out.reshape(-1)


def cascade(table: DataFrame, chosen: DataFrame) -> list[np.ndarray]:
    """Filters that tell the places ``chosen`` from the others of ``table``; both are materialised."""
    filters, inside, outside = [], chosen, table
    while not inside.isEmpty():
        level = len(filters)
        filters.append(filter_of(inside, level))
        shared = table.sparkSession.sparkContext.broadcast(filters[-1])

        def passing(batches: Iterator[pa.RecordBatch], shared=shared, level=level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array(passes([shared.value], *arrays(batch), level) > 0))

        found = outside.select(*PLACE).mapInArrow(passing, TYPES)
        # the first table still holds the set itself; later ones are apart from what the filter holds
        inside, outside = materialise(found.join(inside.select(*PLACE), PLACE, "left_anti") if level == 0 else found), inside
    return filters
