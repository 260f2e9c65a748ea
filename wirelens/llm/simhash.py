"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in up to `radius` bits have a variant in common that each reaches by
changing half of these bits. Every fingerprint emits its variants, they are shuffled by value, and
fingerprints that meet are linked after their distance is checked. Distinct fingerprints only: exact
copies share theirs.

Fewer variants suffice when the two sides differ. A pair with an odd distance has one fingerprint with an
even number of ones; that side changes the smaller half and the other side the larger half. At radius 3
two of three positions lie in the same half of the word, so the larger half is a pair of bits from one
half. That makes 65 variants for an even and 1056 for an odd fingerprint.

At a variant, everybody is linked to one of those closest to it: at most half the radius away, hence
within the radius of all others that the variant is for. So a group of any size gives a star, not all
its pairs, and no link between components is lost.

Defined results: a text without words has fingerprint 0 and links like any other; a text of fewer words
than a shingle is one shingle; null texts are empty. Equal texts and repeated rows share a fingerprint.
Documents with a null id take their group's component; a fingerprint of only such rows has none (null).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wirelens.llm.blocks import part_of, planes, values_of
from wirelens.llm.common import chunks, components, text_of
from wirelens.session import broadcast_table, measured_table

BITS = 64
SEED = 42
#: Variants made at a time, and bytes of variants that one task compares.
EMITTED = 1 << 20
TASK_BYTES = 16_000_000


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes], size: int) -> list[bytes]:
    if len(words) <= size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)))))


def simhash(words: list[bytes], size: int) -> int:
    """Bits that are set in more than half of the shingles' hashes."""
    parts = shingles(words, size)
    if not parts:
        return 0
    hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in parts), np.uint64, len(parts))
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(bits), 255):  # sums of bytes that fit a byte
        ones += bits[i : i + 255].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * ones > len(parts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(key, fingerprint) with the fingerprint's bits as a long."""

    def run(batches):
        for batch, texts in chunks(batches):
            found = np.array([simhash(words_of(t), shingle) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(found)], names=[key, "fingerprint"])

    rows = docs.select(F.col(key).cast("long").alias("key"), text_of(text).alias("text"))
    return rows.mapInArrow(run, f"`{key}` long, fingerprint long")


def _masks(radius: int, odd: bool, bits: int = BITS) -> np.ndarray:
    """Changes that a fingerprint makes to its lower `bits` to get its variants."""
    most = radius - radius // 2 if odd else radius // 2
    out = []
    for n in range(most + 1):
        for at in combinations(range(bits), n):
            if radius == 3 and n == 2 and 2 * at[0] // bits != 2 * at[1] // bits:
                continue
            if not n and odd and radius % 2:
                continue  # at odd distances the even side can stay as it is
            out.append(sum(1 << i for i in at))
    return np.array(out, np.uint64)


def links(nodes: DataFrame, n: int, radius: int = 3, bits: int = BITS) -> DataFrame:
    """(a, b) of distinct fingerprints at most `radius` apart: a star at each variant where some meet.

    `nodes` has `fingerprint`, each value once; `n` is their number. Only the lower `bits` may differ. A
    link may come several times.
    """
    sides = [_masks(radius, False, bits), _masks(radius, True, bits)]
    masks = np.unique(np.concatenate(sides))
    codes = [np.searchsorted(masks, side).astype(np.uint16) for side in sides]
    per_node = sum(map(len, sides)) / 2
    parts = max(64, int(n * per_node * 10 // TASK_BYTES))
    spread = max(16, int(n * per_node) // (8 * EMITTED))
    step = max(1, EMITTED // max(map(len, sides)))

    def emit(batches):
        for batch in batches:
            all_found = batch.column("fingerprint").to_numpy().view(np.uint64)
            for first in range(0, len(all_found), step):
                found = all_found[first : first + step]
                odd = np.bitwise_count(found) & 1
                variants = np.concatenate(
                    [(found[odd == side][:, None] ^ sides[side]).ravel() for side in (0, 1)]
                )
                made_by = np.concatenate([np.tile(codes[side], int((odd == side).sum())) for side in (0, 1)])
                order = np.argsort(variants)
                variants, made_by = variants[order], made_by[order]
                part = part_of(variants, parts)
                order = np.argsort(part, kind="stable")
                part, variants, made_by = part[order], variants[order], made_by[order]
                cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(part[cuts[:-1]].astype(np.int32)),
                        pa.array([planes(variants[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        pa.array([planes(made_by[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary()),
                    ],
                    names=["part", "variants", "made_by"],
                )

    def meet(table: pa.Table) -> pa.Table:
        variants = np.concatenate([values_of(v.as_py(), np.uint64) for v in table.column("variants")])
        made_by = np.concatenate([values_of(v.as_py(), np.uint16) for v in table.column("made_by")])
        order = np.argsort(variants)
        variants, made_by = variants[order], made_by[order]
        same = variants[1:] == variants[:-1]
        several = np.zeros(len(variants), bool)
        several[1:] |= same
        several[:-1] |= same
        variants, change = variants[several], masks[made_by[several]]
        member, moved = variants ^ change, np.bitwise_count(change)
        order = np.lexsort((member, moved, variants))  # the closest comes first
        variants, member = variants[order], member[order]
        heads = np.flatnonzero(np.diff(variants, prepend=variants[:1] + np.uint64(1)))
        center = np.repeat(member[heads], np.diff(np.append(heads, len(variants))))
        near = (np.bitwise_count(center ^ member) <= radius) & (center != member)
        pairs = np.unique(np.stack([center[near], member[near]], axis=1), axis=0).view(np.int64)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    emitted = nodes.select("fingerprint").repartition(spread).mapInArrow(
        emit, "part int, variants binary, made_by binary"
    )
    return emitted.groupBy("part").applyInArrow(meet, "a long, b long")


def near_duplicates(found: DataFrame, key: str = "doc_id", radius: int = 3) -> DataFrame:
    """(key, fingerprint, component) for rows of `fingerprints`: the smallest key reachable by links."""
    found, _ = measured_table(found, "simhash")
    nodes, seen = measured_table(found.groupBy("fingerprint").agg(F.min(key).alias("least")), "simhash-nodes")
    nodes_with_id = nodes.where("least is not null")
    reached = components(links(nodes_with_id, seen["n"], radius))
    placed = nodes.join(reached.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").select(
        "fingerprint", "least", F.coalesce("component", "fingerprint").alias("group")
    )
    smallest = placed.groupBy("group").agg(F.min("least").alias("component"))
    named, rows = measured_table(placed.join(smallest, "group").select("fingerprint", "component"), "simhash-groups")
    return found.join(broadcast_table(named, rows["n"]), "fingerprint").select(key, "fingerprint", "component")


def hexadecimal(fingerprint: str = "fingerprint"):
    """The fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
