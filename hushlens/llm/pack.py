"""Filling fixed-capacity containers with items, by conflict-constrained best fit.

Each text is measured in tokens; only a text larger than a container is cut, into full containers' worth and a rest. Items
are dealt by a hash of their id into groups of about `group_rows`, and each group is packed by one task: items in falling
order of size, bins ordered by what room they have left, each bin carrying one bitmap of its sources and one of its duplicate
clusters. The search starts at the bins with exactly enough room and goes on to the successor until a bin without a conflict
is found, so the tightest compatible bin is taken. A bin conflicts with an item if it holds a text of the same duplicate
cluster, or would mix more than `max_sources` sources. A cluster with more copies than its group has containers is dealt
round into subclusters of that many copies; only copies of one subcluster conflict, so a hot cluster costs no extra room.

Duplicate cluster: what a column of the caller's says, such as the classes of a near-duplicate search; without one, equal text
after lower-casing and joining white space. Defined results: a null cluster is no duplicate of anything; null, empty and blank texts have
their tokens (0 for null) and are packed too; a null source is a source of its own; repeated rows are one cluster; equal
sizes are taken by hash of the id, then id; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZERS, arrow_schema, cut_lineage, map_columns, spread, transposed
from .tokens import VOCABULARY, token_pieces

CAPACITY = 4_096


class Bins:
    """Bins in order of residual room; a bit set of the residuals in use makes the successor search a few integer operations."""

    def __init__(self, capacity: int, max_sources: int):
        self.capacity, self.max_sources = capacity, max_sources
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0
        self.left: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.items: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> tuple[int, int]:
        """Put an item into the tightest bin without a conflict, or into a new one; its bin and its place there."""
        rest = self.used >> size
        residual = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            residual += step
            for slot in range(len(self.at[residual]) - 1, -1, -1):
                b = self.at[residual][slot]
                if not self.clusters[b] & cluster and (self.sources[b] | source).bit_count() <= self.max_sources:
                    self.at[residual].pop(slot)
                    if not self.at[residual]:
                        self.used &= ~(1 << residual)
                    return self._fill(b, size, source, cluster)
            rest >>= step + 1
            residual += 1
        self.left.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.items.append(0)
        return self._fill(len(self.left) - 1, size, source, cluster)

    def _fill(self, b: int, size: int, source: int, cluster: int) -> tuple[int, int]:
        self.left[b] -= size
        self.sources[b] |= source
        self.clusters[b] |= cluster
        self.at[self.left[b]].append(b)
        self.used |= 1 << self.left[b]
        self.items[b] += 1
        return b, self.items[b] - 1


def pack_group(sizes: list[int], sources: list, clusters: list[int], capacity: int = CAPACITY, max_sources: int = 4) -> list[tuple[int, int, int]]:
    """(bin, place, offset in tokens) of every item of one group, in the order given; items come in falling size."""
    expected = max(1, -(-sum(sizes) // capacity))
    copies = Counter(clusters)
    source_bit = {s: 1 << k for k, s in enumerate(dict.fromkeys(sources))}
    cluster_bit: dict[tuple[int, int], int] = {}
    seen: Counter = Counter()
    bins, out = Bins(capacity, max(1, max_sources)), []
    for size, source, cluster in zip(sizes, sources, clusters):
        bit = 0
        if copies[cluster] > 1:  # only texts that occur twice can conflict, so only they get a bit
            key = (cluster, seen[cluster] // expected)
            seen[cluster] += 1
            bit = cluster_bit.setdefault(key, 1 << len(cluster_bit))
        b, place = bins.place(size, source_bit[source], bit)
        out.append((b, place, capacity - bins.left[b] - size))
    return out


def measured(df: DataFrame, *, key: str, text: str, source: str, capacity: int, folder: str, vocabulary: str, cluster: str | None = None) -> DataFrame:
    """Items: _key, _source, _cluster, piece, n_pieces, start_char, end_char, tokens."""
    rows = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"))
    same = F.xxhash64(F.lower(F.trim(F.regexp_replace("_text", r"\s+", " "))), F.col("_text").isNull())
    if cluster is not None:
        rows = df.select(F.col(key).alias("_key"), F.col(source).cast("string").alias("_source"), F.col(text).alias("_text"), F.col(cluster).alias("_named"))
        same = F.when(F.col("_named").isNotNull(), F.xxhash64("_named")).otherwise(F.xxhash64("_key", "_text", F.lit(1)))
    rows = rows.withColumn("_cluster", same).select("_key", "_source", "_text", "_cluster")
    key_type = df.schema[key].dataType.simpleString()

    def measure(keys: list, sources: list, texts: list, clusters: list) -> list:
        out = []
        for k, s, t, c in zip(keys, sources, texts, clusters):
            pieces = [(0, 0, 0)] if t is None else token_pieces(t, capacity, folder, vocabulary)
            out += [(k, s, c, n, len(pieces), *piece) for n, piece in enumerate(pieces)]
        return transposed(out, 8)

    schema = f"_key {key_type}, _source string, _cluster bigint, piece int, n_pieces int, start_char int, end_char int, tokens int"
    return map_columns(spread(rows, F.xxhash64("_key", "_text")), lambda: measure, schema)


def pack(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", capacity: int = CAPACITY, max_sources: int = 4, group_rows: int = 20_000, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY, cluster: str | None = None) -> DataFrame:
    """Container and place of every text or piece: key, piece, n_pieces, start_char, end_char, tokens, container, place, offset.

    The sizes are checkpointed, so that counting them for the number of groups does not tokenize twice. A group's task holds
    about group_rows rows of numbers, no texts.
    """
    items = cut_lineage(measured(df, key=key, text=text, source=source, capacity=capacity, folder=folder, vocabulary=vocabulary, cluster=cluster))
    groups = max(1, -(-items.count() // group_rows))
    key_type = df.schema[key].dataType.simpleString()

    schema = f"_key {key_type}, piece int, n_pieces int, start_char int, end_char int, tokens int, container string, place int, offset int"
    result = arrow_schema(schema)

    def fill(group: pa.Table) -> pa.Table:
        rows = sorted(group.to_pylist(), key=lambda r: (-r["tokens"], r["_turn"], r["_key"] is None, r["_key"], r["piece"]) if r["_key"] is not None else (-r["tokens"], r["_turn"], True, 0, r["piece"]))
        places = pack_group([r["tokens"] for r in rows], [r["_source"] for r in rows], [r["_cluster"] for r in rows], capacity, max_sources)
        for r, (b, place, offset) in zip(rows, places):
            r |= {"container": f"{r['_group']}-{b}", "place": place, "offset": offset}
        return pa.Table.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in result], schema=result)

    dealt = items.withColumn("_turn", F.xxhash64("_key", "piece")).withColumn("_group", F.pmod("_turn", F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(fill, schema).withColumnRenamed("_key", key)


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Containers, tokens and the share of room left unused."""
    per = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return per.agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"), (1 - F.sum("tokens") / (F.count(F.lit(1)) * capacity)).alias("unused_share"))
