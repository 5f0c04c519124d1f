"""Near-duplicate join on word shingles with a MinHash LSH forest and exact verification.

1. Texts of equal word sequences are one class; only its representative (least doc_id) goes on.
2. Every representative has ``TREES`` tries over ``DEPTH`` min-hashes each. Representatives that share a
   prefix of a trie are compared by their signatures, starting with full-length prefixes. The recall so
   far is estimated from what was found (each pair weighs one over its chance to be found at that
   prefix length); prefixes are shortened by one until the estimate reaches ``target_recall``.
3. Alike signatures connect representatives to components. Texts are brought together by component and
   every pair of a component is verified on its whole shingle sets.
4. Verified links give each document its number of links and, through connected components, its class.

A trie node or component of more than ``TILE`` members is dealt out: members are split by hash into
chunks of about that size and every two chunks meet in a task of their own. So no task holds more than
two chunks, no pair is left out, and what is written per tile is a row or two for each member, never
one for each pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import cut_lineage
from .blocks import BASE, U64, Block, column, group_bounds, mix, slices, text_array, whole_groups, windows
from .components import components

WORDS = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 4
TARGET_RECALL = 0.9998
TILE = 256
#: Signatures of two texts at the threshold agree in fewer than this share with a chance of about 1e-8.
_ALIKE = THRESHOLD - 0.3

_SALTS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (2, TREES * DEPTH), dtype=np.uint64) | U64(1)


def chance(similarity, depth: int, trees: int = TREES):
    """The chance that two texts of this similarity share a prefix of ``depth`` in some trie."""
    return 1 - (1 - similarity ** depth) ** trees


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            words = Block.of(text_array(part)).words()
            hashes, n = words.hashes(), len(words.of) - 1
            full = np.flatnonzero(words.counts())
            found, _, of = windows(hashes, words.of, WORDS)
            keys = np.zeros((2, n), np.int64)
            place = mix(np.arange(len(hashes), dtype=U64) - np.repeat(words.of[:-1], words.counts()).astype(U64) + U64(BASE))
            signature = np.zeros((n, TREES * DEPTH), np.uint32)
            if len(full):
                for k in range(2):
                    keys[k][full] = np.add.reduceat(mix((hashes ^ U64(k)) * (place | U64(1))), words.of[:-1][full]).view(np.int64)
                for j in range(TREES * DEPTH):
                    values = (found ^ _SALTS[0, j]) * _SALTS[1, j]
                    signature[full, j] = np.minimum.reduceat(values, of[:-1][full]) >> U64(32)
            signature = mix(signature.astype(U64)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(keys[0]), pa.array(keys[1]), pa.array(words.counts()),
                 pa.array([x.tobytes() for x in signature], pa.binary())],
                names=["doc_id", "k1", "k2", "n_words", "signature"])


def _labels(alike: np.ndarray) -> np.ndarray:
    """Least member of each node's component in a small graph given as a matrix (with a true diagonal)."""
    label = np.arange(len(alike))
    while True:
        new = np.where(alike, label[None, :], len(alike)).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _tiled(members: DataFrame, key: str, size: str) -> DataFrame:
    """Rows of ``members`` dealt to the tiles (key, a, b) of their group; ``own`` is the row's chunk."""
    chunks = F.ceil(F.col(size) / TILE).cast("int")
    own = F.pmod(F.xxhash64("id"), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    return (members.withColumn("own", own).withColumn("other", other)
            .withColumn("a", F.least("own", "other").cast("bigint")).withColumn("b", F.greatest("own", "other").cast("bigint"))
            .drop("other", size).withColumnRenamed(key, "key"))


def _agreement(signatures: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every two signatures: equal min-hashes, and tries in which they share a prefix of ``depth``."""
    m = len(signatures)
    equal, trees = np.zeros((m, m), np.int16), np.zeros((m, m), np.int16)
    step = max(1, min(TREES, (1 << 20) // (m * m * DEPTH)))
    for t in range(0, TREES, step):
        part = signatures[:, t * DEPTH:(t + step) * DEPTH]
        same = (part[:, None, :] == part[None, :, :]).reshape(m, m, -1, DEPTH)
        equal += same.sum(axis=(2, 3), dtype=np.int16)
        trees += same[..., :depth].all(axis=3).sum(axis=2, dtype=np.int16)
    return equal, trees


def _compared(depth: int):
    """Compares the signatures of every tile; rows are edges (id, label) or, with a null id, sums for the recall."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, ["key", "a", "b"]):
            bounds, out = group_bounds(table, ["key", "a", "b"]), [[], [], [], []]
            ids, own, a, b = (column(table, c) for c in ("id", "own", "a", "b"))
            low = np.frombuffer(b"".join(table.column("signature").to_pylist()), np.uint8).reshape(table.num_rows, -1)
            for s, e in zip(bounds[:-1], bounds[1:]):
                order = s + np.argsort(ids[s:e])
                sig, name, side = low[order], ids[order], own[order]
                equal, trees = _agreement(sig, depth)
                if a[s] != b[s]:
                    cross = side[:, None] != side[None, :]
                    equal[~cross] = 0
                share = equal / sig.shape[1]
                alike = (share >= _ALIKE) & (trees > 0)
                np.fill_diagonal(alike, True)
                label = _labels(alike)
                moved = np.flatnonzero(label != np.arange(e - s))
                out[0].extend(name[moved].tolist())
                out[1].extend(name[label[moved]].tolist())
                out[2].extend([0.0] * len(moved))
                out[3].extend([0.0] * len(moved))
                i, j = np.nonzero(np.triu(alike & (share >= THRESHOLD), 1))
                if len(i):  # a pair shows up in each of the tries it shares a prefix in
                    weight = 1 / trees[i, j]
                    for x, v in zip(out, (None, None, float(weight.sum()), float((weight / chance(share[i, j], depth)).sum()))):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()),
                                              pa.array(out[2], pa.float64()), pa.array(out[3], pa.float64())],
                                             names=["a", "b", "found", "expected"])
    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Exact similarities within every tile of a component: (id, links, label)."""
    for table in whole_groups(batches, ["key", "a", "b"]):
        bounds = group_bounds(table, ["key", "a", "b"])
        ids, own, a, b, copies = (column(table, c) for c in ("id", "own", "a", "b", "n"))
        out_id, out_links, out_label = [], [], []
        for s, e in zip(bounds[:-1], bounds[1:]):
            group, at = table.slice(s, e - s), s
            sets: list[np.ndarray] = []
            for part in slices(group, "text"):
                words = Block.of(text_array(part)).words()
                found, _, of = windows(words.hashes(), words.of, WORDS)
                sets.extend(np.unique(found[x:y]) for x, y in zip(of[:-1], of[1:]))
            m, size = e - s, np.array([len(x) for x in sets])
            doc, every = np.repeat(np.arange(m, dtype=np.int32), size), np.concatenate(sets)
            del sets  # a tile may hold hundreds of long texts: only what the next step needs stays
            order = np.argsort(every, kind="stable")
            doc, every = doc[order], every[order]
            del order
            new = np.ones(len(every) + 1, bool)
            new[1:-1] = every[1:] != every[:-1]
            del every
            shared = ~(new[:-1] & new[1:])  # what one text has alone adds to no intersection
            doc, number = doc[shared], np.cumsum(new[:-1][shared], dtype=np.int32) - 1
            del new, shared
            common = np.zeros((m, m), np.float32)
            for first in range(0, int(number.max()) + 1 if len(number) else 0, 4096):
                lo, hi = np.searchsorted(number, [first, first + 4096])
                hold = np.zeros((m, min(4096, int(number[hi - 1]) - first + 1)), np.float32)
                hold[doc[lo:hi], number[lo:hi] - first] = 1
                common += hold @ hold.T
            # intersection / union >= 0.8 in whole numbers
            linked = 9 * common.astype(np.int64) >= 4 * (size[:, None] + size[None, :])
            if a[s] != b[s]:
                linked &= own[s:e, None] != own[None, s:e]
            np.fill_diagonal(linked, False)
            links = linked @ copies[at:e]
            np.fill_diagonal(linked, True)
            order = np.argsort(ids[s:e])
            label = np.empty(m, np.int64)
            label[order] = ids[s:e][order][_labels(linked[np.ix_(order, order)])]
            some = (links > 0) | (label != ids[s:e])
            out_id.append(ids[s:e][some])
            out_links.append(links[some])
            out_label.append(label[some])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in (out_id, out_links, out_label)],
                                         names=["id", "links", "label"])


def candidate_edges(representatives: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """Edges between representatives (doc_id, signature) of alike signatures that share a prefix in some trie."""
    values = representatives.select(
        F.col("doc_id").alias("id"), "signature",
        F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring(F.hex("signature"), t * DEPTH * 8 + 1, F.lit(DEPTH * 8))).alias("tries"))
    # One byte of each min-hash is enough to compare signatures.
    low = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(TREES * DEPTH - 1)),
                                           lambda i: F.substring(F.hex("signature"), i * 8 + 1, F.lit(2))), ""))
    values = cut_lineage(values.select("id", low.alias("signature"), "tries"), "tries")
    found = None
    for depth in range(DEPTH, 0, -1):
        nodes = values.select("id", "signature", F.posexplode("tries").alias("tree", "trie")).select(
            F.xxhash64("tree", F.substring("trie", 1, depth * 8)).alias("node"), "id", "signature")
        sizes = nodes.groupBy("node").agg(F.count("*").alias("size")).where("size > 1")
        tiles = _tiled(nodes.join(sizes, "node"), "node", "size")
        compared = cut_lineage(
            tiles.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
            .mapInArrow(_compared(depth), "a bigint, b bigint, found double, expected double"), "alike")
        edges = compared.where("a is not null").select("a", "b")
        found = edges if found is None else found.union(edges)
        sums = compared.agg(F.sum("found").alias("found"), F.sum("expected").alias("expected")).first()
        worst = chance(THRESHOLD, depth)
        if worst >= target_recall or worst >= 0.999 and (sums["found"] or 0) >= target_recall * (sums["expected"] or 0):
            break
    return found


def near_duplicates(documents: DataFrame, target_recall: float = TARGET_RECALL) -> DataFrame:
    """(doc_id, class_id, n_links): one row for each row of ``documents`` (doc_id, text).

    Two documents are linked if the Jaccard similarity of their sets of 5-word shingles is 0.8 or more;
    a text of fewer words has one shingle. ``n_links`` counts the other documents linked to it, copies
    included, and ``class_id`` is the least doc_id connected to it by links. A document without words, with
    a null text or without an id has no links and is its own class. Rows that repeat a doc_id count as
    copies. Other columns are ignored.
    """
    rows = cut_lineage(documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
        _signatures, "doc_id bigint, k1 bigint, k2 bigint, n_words bigint, signature binary"), "signatures")
    useful = rows.where("n_words > 0 and doc_id is not null")
    classes = cut_lineage(useful.groupBy("k1", "k2").agg(F.min("doc_id").alias("representative"), F.count("*").alias("n")), "classes")
    chosen = (classes.select(F.col("representative").alias("doc_id"), "k1", "k2")
              .join(useful.select("doc_id", "k1", "k2", "signature"), ["doc_id", "k1", "k2"]).dropDuplicates(["doc_id"]))
    found = components(candidate_edges(chosen.select("doc_id", "signature"), target_recall))
    sizes = found.groupBy("label").agg(F.count("*").alias("size"))
    members = (found.join(sizes, "label").join(classes.select(F.col("representative").alias("id"), "k1", "k2", "n"), "id")
               .groupBy("id", "label", "size").agg(F.sum("n").alias("n")))
    texts = members.join(documents.select(F.col("doc_id").cast("bigint").alias("id"), F.col("text").cast("string")), "id").dropDuplicates(["id"])
    tiles = _tiled(texts, "label", "size")
    verified = cut_lineage(tiles.repartition("key", "a", "b").sortWithinPartitions("key", "a", "b")
                           .mapInArrow(_verified, "id bigint, links bigint, label bigint"), "verified")
    links = verified.groupBy("id").agg(F.sum("links").alias("links"))
    labels = components(verified.where("id <> label").select(F.col("id").alias("a"), F.col("label").alias("b")))
    by_class = (classes.join(links, classes.representative == links.id, "left").drop("id")
                .join(labels, classes.representative == labels.id, "left")
                .select("k1", "k2", F.coalesce("label", "representative").alias("class_id"),
                        (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links")))
    return useful.select("doc_id", "k1", "k2").join(by_class, ["k1", "k2"]).select("doc_id", "class_id", "n_links").union(
        rows.where("not (n_words > 0 and doc_id is not null)").select("doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("bigint")))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stay: of each class the row with the least doc_id, and rows without an id.

    Of rows that repeat a doc_id one stays (the least text).
    """
    kept = near_duplicates(documents).where("doc_id = class_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = documents.join(kept, documents.doc_id.cast("bigint") == kept["__kept"]).withColumn(
        "__row", F.row_number().over(Window.partitionBy("__kept").orderBy("text"))).where(F.col("__row") == 1)
    return named.select(*documents.columns).union(documents.where("doc_id is null"))
