"""Near-duplicate detection with DartMinHash signatures and banded joins.

Texts are sets (or, with ``weighting="count"``, multisets) of shingles of five
words. DartMinHash throws darts at the plane of weight and rank of each element:
how many land in a region, and where, follows from hashes of the element and
the region alone, so equal elements of two texts get equal darts. A text sees the
darts below its elements' weights and below a rank that falls with its total
weight, about ``k ln k + 2k`` in all however long it is. Each dart belongs to one
of ``k`` coordinates; the dart of least rank is the signature there. Two texts
agree in a coordinate with the probability of their weighted Jaccard similarity.

Bands of four coordinates make the buckets. At a similarity of 0.8 two texts
share none of the 32 bands with a probability of 5e-8. Equal texts are
collapsed first. A bucket of few texts offers all its pairs; a larger one links
each text to one common text. Candidates are checked exactly on their shingle
sets, and classes are the connected components of the links. In large buckets that
still hold several classes, texts outside the largest one are compared with all
others inside the tasks, exactly and without giving out pairs but links: a
group of copies never gives all its pairs, and no link between classes is lost.

Defined results: a text without words (null, empty or white space) is a class
of its own, one per row. A text of fewer than five words is one shingle.
Repeated rows are copies like any other. The class id is the least key of
the class; null keys come last, so it is null only if all keys are. An empty
table gives no rows. Kept columns of any name are carried inside a struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import byte_groups
from foliospark.operators.scale import join_by_key
from foliospark.session import materialise

SHINGLE_WORDS = 5
SIMILARITY = 0.8
COORDINATES = 128
BAND_ROWS = 4
SMALL_BUCKET = 8
COMPARED = 2000
GROUP_BYTES = 4_000_000

_STEPS: dict[float, np.ndarray] = {}  # by area, filled as regions are met

FIRST_RANK = 2.0**-6  # end of the first region of ranks; each next one doubles it


def mixed(values: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each number, different for each salt."""
    h = values + np.uint64((salt * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fraction(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(11)).astype(np.float64) * 2.0**-53


def poisson_steps(area: float) -> np.ndarray:
    """The cumulative probabilities of 0, 1, 2, ... darts in a region."""
    most = int(area + 12 * np.sqrt(area) + 20)
    logs = np.cumsum(np.log(np.arange(1, most + 1)))
    chances = np.exp(np.arange(most + 1) * np.log(area) - area - np.append(0, logs))
    return np.cumsum(chances)


def regions(most: float, first: float) -> Iterator[tuple[int, float, float]]:
    """Number and ends of the regions of one axis up to ``most``."""
    low, high, number = 0.0, first, 0
    while low < most:
        yield number, low, high
        low, high, number = high, 2 * high, number + 1


def throw(
    element: np.ndarray, weight: np.ndarray, rank_limit: np.ndarray, from_rank: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Darts that each element row sees: its row, the dart's hash and its rank.

    Ranks lie from ``from_rank`` up to, not including, ``rank_limit``.
    """
    rows, darts, ranks = [], [], []
    if not len(element):
        return np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0)
    for v, w_low, w_high in regions(float(weight.max()), 1.0):
        tall = np.flatnonzero(weight > w_low)
        for r, r_low, r_high in regions(float(rank_limit.max()), FIRST_RANK):
            at = tall[(rank_limit[tall] > r_low) & (from_rank[tall] < r_high)]
            if not len(at):
                continue
            area = (w_high - w_low) * (r_high - r_low)
            if area not in _STEPS:
                _STEPS[area] = poisson_steps(area)
            steps = _STEPS[area]
            region = mixed(element[at], 64 * v + r)
            chance = fraction(region)
            hit = chance >= steps[0]
            at, region, chance = at[hit], region[hit], chance[hit]
            count = np.minimum(np.searchsorted(steps, chance, "right"), len(steps) - 1)
            row = np.repeat(at, count)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            dart = mixed(np.repeat(region, count) ^ nth.astype(np.uint64), 7)
            rank = r_low + (r_high - r_low) * fraction(mixed(dart, 11))
            seen = (rank < rank_limit[row]) & (rank >= from_rank[row])
            if w_high > 1.0:
                height = w_low + (w_high - w_low) * fraction(mixed(dart, 13))
                seen &= height < weight[row]
            rows.append(row[seen])
            darts.append(dart[seen])
            ranks.append(rank[seen])
    return np.concatenate(rows), np.concatenate(darts), np.concatenate(ranks)


def signatures(
    text: np.ndarray,
    element: np.ndarray,
    weight: np.ndarray,
    texts: int,
    coordinates: int = COORDINATES,
) -> np.ndarray:
    """The signature of each text, given rows (text, element, weight > 0)."""
    total = np.bincount(text, weight, texts)
    darts_wanted = coordinates * np.log(coordinates) + 2 * coordinates
    limit = np.divide(darts_wanted, total, out=np.zeros(texts), where=total > 0)
    least = np.full(texts * coordinates, np.inf)
    found = np.zeros(texts * coordinates, np.uint64)
    open_rows, low = np.arange(len(text)), np.zeros(texts)
    while len(open_rows):
        of_text = text[open_rows]
        row, dart, rank = throw(
            element[open_rows], weight[open_rows], limit[of_text], low[of_text]
        )
        coordinate = (mixed(dart, 17) % np.uint64(coordinates)).astype(np.int64)
        cell = of_text[row] * coordinates + coordinate
        np.minimum.at(least, cell, rank)
        first = rank == least[cell]
        found[cell[first]] = dart[first]
        # A text with a coordinate that no dart has hit sees twice as far.
        empty = np.isinf(least.reshape(texts, coordinates)).any(1)
        low = limit
        limit = np.where(empty, 2 * limit, limit)
        open_rows = open_rows[empty[of_text]]
    return found.reshape(texts, coordinates)


def shingle_rows(
    texts: list[bytes], words: int = SHINGLE_WORDS
) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Distinct shingles as rows (text, hash, count), and each text's fingerprint."""
    split = [t.split() for t in texts]
    hash_of = {w: 0 for part in split for w in part}
    for w in hash_of:
        hash_of[w] = xxhash.xxh3_64_intdigest(w)
    sizes = np.array([len(part) for part in split], np.int64)
    flat = np.fromiter(
        (h for part in split for h in map(hash_of.__getitem__, part)),
        np.uint64,
        int(sizes.sum()),
    )
    prints = [xxhash.xxh3_128_digest(b" ".join(part)) if part else b"" for part in split]
    text = np.repeat(np.arange(len(texts)), sizes)
    ends = np.cumsum(sizes)
    hashed = np.zeros(len(flat), np.uint64)
    for k in range(words):
        # A short text ends before its shingle does: what is missing adds nothing.
        size = len(flat) - k
        if size <= 0:
            break
        same = text[:size] == text[k:]
        hashed[:size] += np.where(same, mixed(flat[k:], k), np.uint64(0))
    starts = ends - sizes
    last = np.maximum(ends - words, starts)  # the last shingle of each text
    kept = np.arange(len(flat)) <= last[text]
    text, hashed = text[kept], mixed(hashed[kept], 99)
    order = np.lexsort((hashed, text))
    text, hashed = text[order], hashed[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (hashed[1:] != hashed[:-1])
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(text)))
    return text[at], hashed[at], counts, prints


def sketch(
    df: DataFrame, text: str = "text", kept: list[str] | None = None, weighting: str = "set"
) -> DataFrame:
    """Each row with its number, text id, shingles and bucket keys.

    Columns: ``row_id``, ``kept`` (struct of the kept columns), ``text_id`` (equal
    for equal word sequences; null without words), ``n`` (total weight),
    ``shingles`` (sorted 32-bit hashes, each repeated as often as it counts) and
    ``buckets``.
    """
    rows = df.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.struct(*(kept or df.columns)).alias("kept"),
        F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"),
    )
    schema = (
        f"row_id long, kept {rows.schema['kept'].dataType.simpleString()}, "
        "text_id binary, n long, shingles binary, buckets array<long>"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data in byte_groups(batches, GROUP_BYTES):
            of_text, hashed, counts, prints = shingle_rows(data)
            weight = counts if weighting == "count" else np.ones_like(counts)
            total = np.bincount(of_text, weight, len(data)).astype(np.int64)
            found = signatures(of_text, hashed, weight.astype(np.float64), len(data))
            bands = np.zeros((len(data), COORDINATES // BAND_ROWS), np.uint64)
            for k in range(COORDINATES):
                bands[:, k // BAND_ROWS] += mixed(found[:, k], k)
            keys = mixed(bands, 5).astype(np.int64).tolist()
            bounds = np.searchsorted(of_text, np.arange(len(data) + 1))
            ends = np.append(0, np.cumsum(weight))
            short = np.repeat((hashed >> np.uint64(32)).astype("<u4"), weight)
            cuts = ends[bounds].tolist()
            sets = [short[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("row_id"),
                    part.column("kept"),
                    pa.array([p or None for p in prints], pa.binary()),
                    pa.array(total),
                    pa.array(sets, pa.binary()),
                    pa.array([k if p else [] for k, p in zip(keys, prints)], pa.list_(pa.int64())),
                ],
                ["row_id", "kept", "text_id", "n", "shingles", "buckets"],
            )

    return rows.mapInArrow(run, schema)


def similarity(a: bytes, b: bytes) -> float:
    """Weighted Jaccard similarity of two shingle lists."""
    left, right = (np.frombuffer(x, "<u4") for x in (a, b))
    both = np.sort(np.concatenate([numbered(left), numbered(right)]))
    common = int((both[1:] == both[:-1]).sum())
    return common / max(len(both) - common, 1)


def numbered(shingles: np.ndarray) -> np.ndarray:
    """Sorted shingles with the number of each among its equals."""
    new = np.ones(len(shingles), bool)
    new[1:] = shingles[1:] != shingles[:-1]
    first = np.flatnonzero(new)
    nth = np.arange(len(shingles)) - first[np.cumsum(new) - 1]
    return (shingles.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64)


def check_pairs(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose shingles are at least that similar.

    Totals are compared before the sets are fetched: too unequal texts cannot be
    similar enough.
    """
    sizes = texts.select("node", "n")
    sized = (
        pairs.join(sizes.toDF("a", "n_a"), "a")
        .join(sizes.toDF("b", "n_b"), "b")
        .filter(F.least("n_a", "n_b") >= threshold * F.greatest("n_a", "n_b"))
        .select("a", "b")
    )
    sets = texts.select("node", "shingles")
    full = sized.join(sets.toDF("a", "s_a"), "a").join(sets.toDF("b", "s_b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("s_a"), batch.column("s_b")
            near = [
                similarity(x.as_py(), y.as_py()) >= threshold for x, y in zip(left, right)
            ]
            kept = batch.filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays(
                [kept.column("a"), kept.column("b")], ["a", "b"]
            )

    return full.select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def first_candidates(shared: DataFrame) -> DataFrame:
    """Pairs of small buckets, and of each text with the common one of a large bucket."""
    listed = (
        shared.filter(F.col("texts") <= SMALL_BUCKET)
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    )
    small = listed.select(F.posexplode("nodes").alias("at", "a"), "nodes").select(
        "a", F.explode(F.slice("nodes", F.col("at") + 2, SMALL_BUCKET)).alias("b")
    )
    large = shared.filter(F.col("texts") > SMALL_BUCKET).filter("node <> centre")
    star = large.select(
        F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")
    )
    return small.union(star).distinct()


def components(links: DataFrame) -> DataFrame:
    """Node and class label of every node that has a link.

    Each round every node takes the least label around it and then the label of
    that label; both steps are partial aggregates and joins on the node.
    """
    both = materialise(links.union(links.select("b", "a")).toDF("node", "other"), "links")
    labels = both.groupBy("node").agg(F.min("other").alias("other")).select(
        "node", F.least("node", "other").alias("label")
    )
    labels = materialise(labels, "labels")
    while True:
        around = both.join(labels.toDF("other", "seen"), "other")
        least = around.groupBy("node").agg(F.min("seen").alias("seen"))
        moved = labels.join(least, "node").select(
            "node", F.least("label", "seen").alias("near"), "label"
        )
        jumped = moved.join(labels.toDF("near", "far"), "near").select(
            "node", F.least("near", "far").alias("label"), F.col("label").alias("before")
        )
        following = materialise(jumped, "labels")
        changed = not following.filter("label <> before").isEmpty()
        labels = following.select("node", "label")
        if not changed:
            return labels


def classes(sketched: DataFrame, nodes: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Label of every node that is linked to another one.

    ``nodes`` has the row that stands for each distinct text. Sketches stay where
    they lie as long as the row ids looked for are few enough to broadcast.
    """
    single = join_by_key(
        sketched.withColumnRenamed("row_id", "node"), nodes.select("node"), ["node"], "left_semi"
    )
    members = materialise(single.select("node", F.explode("buckets").alias("bucket")), "members")
    counts = (
        members.groupBy("bucket")
        .agg(
            F.count("*").alias("texts"),
            F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("centre"),
        )
        .filter("texts > 1")
    )
    # Only texts that share a bucket go on; most of a corpus ends here.
    shared = materialise(members.join(counts, "bucket"), "buckets")
    wanted = materialise(shared.select("node").distinct(), "wanted")
    kept = materialise(
        join_by_key(single.select("node", "n", "shingles"), wanted, ["node"], "left_semi"),
        "shingles",
    )
    tested = materialise(first_candidates(shared), "candidates")
    links = materialise(check_pairs(tested, kept, threshold), "links")
    labels = components(links)
    # Texts of one large bucket that are in different classes so far.
    large = shared.filter(F.col("texts") > SMALL_BUCKET).select("bucket", "node")
    placed = large.join(labels, "node", "left").select(
        "bucket", "node", F.coalesce("label", "node").alias("label")
    )
    of_class = placed.groupBy("bucket", "label").count()
    mixed_up = (
        of_class.groupBy("bucket")
        .agg(
            F.sum("count").alias("texts"),
            F.count("*").alias("classes"),
            F.max_by("label", F.struct("count", "label")).alias("main"),
        )
        .filter("classes > 1")
        .select("bucket", "texts", "main")
    )
    rest = materialise(placed.join(mixed_up, "bucket"), "mixed")
    if rest.isEmpty():
        return labels
    more = materialise(compare_classes(rest, kept, threshold), "links")
    return labels if more.isEmpty() else components(links.union(more))


def compare_classes(rest: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links between different classes of the large buckets.

    Members outside a bucket's main class are compared with all of the bucket, in
    blocks of ``COMPARED`` members a side, by products of incidence matrices inside
    the task. Only links leave it, one for each member and other class.
    """
    parts = F.ceil(F.col("texts") / COMPARED).cast("int")
    own = F.pmod(F.xxhash64("node"), parts).cast("int").alias("own")
    held = rest.select("bucket", "node", "label", "main", parts.alias("parts"), own)
    held = held.join(texts.select("node", "shingles"), "node")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    columns = ["bucket", "i", "j", "asks", "node", "label", "shingles"]
    asking = held.filter("label <> main").withColumn("i", F.col("own")).withColumn("j", other)
    asked = held.withColumn("j", F.col("own")).withColumn("i", other)
    both = (
        asking.withColumn("asks", F.lit(True))
        .select(columns)
        .union(asked.withColumn("asks", F.lit(False)).select(columns))
    )

    def run(rows: pa.Table) -> pa.Table:
        asks = rows.column("asks").to_numpy(zero_copy_only=False)
        node, label = rows.column("node").to_numpy(), rows.column("label").to_numpy()
        sets = [
            numbered(np.frombuffer(s, "<u4")) for s in rows.column("shingles").to_pylist()
        ]
        sizes = np.array([len(s) for s in sets])
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        _, column = np.unique(np.concatenate(sets), return_inverse=True)
        row = np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(column, kind="stable")
        column, row = column[order], row[order]
        common = np.zeros((len(left), len(right)), np.float32)
        width = 1 << 12
        place = np.empty(len(sets), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        for first in range(0, int(column[-1]) + 1 if len(column) else 0, width):
            a, b = np.searchsorted(column, (first, first + width))
            sides = []
            for side, count in ((asks, len(left)), (~asks, len(right))):
                at = np.flatnonzero(side[row[a:b]]) + a
                cells = np.zeros((count, width), np.float32)
                cells[place[row[at]], column[at] - first] = 1
                sides.append(cells)
            common += sides[0] @ sides[1].T
        union = sizes[left][:, None] + sizes[right][None, :] - common
        near = (common >= threshold * union) & (label[left][:, None] != label[right][None, :])
        x, y = np.nonzero(near)
        _, once = np.unique(np.stack([x, label[right[y]]]), axis=1, return_index=True)
        a, b = node[left[x[once]]], node[right[y[once]]]
        return pa.table({"a": pa.array(np.minimum(a, b)), "b": pa.array(np.maximum(a, b))})

    found = both.groupBy("bucket", "i", "j").applyInArrow(run, "a long, b long")
    return found.distinct()


def near_duplicates(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    kept: list[str] | None = None,
    threshold: float = SIMILARITY,
    weighting: str = "set",
) -> DataFrame:
    """Every row with its class.

    The columns ``kept`` (default: ``key``), ``class_id`` (the least key of the
    class), ``class_size`` and ``stays`` (true for one row of each class).
    """
    kept = kept or [key]
    carried = list(dict.fromkeys([*kept, key]))
    found = near_duplicate_rows(df, key, text, carried, threshold, weighting)
    own = ("class_id", "class_size", "stays")
    return found.select(*[F.col(f"row.`{c}`").alias(c) for c in kept if c not in own], *own)


def near_duplicate_rows(
    df: DataFrame,
    key: str,
    text: str,
    carried: list[str],
    threshold: float = SIMILARITY,
    weighting: str = "set",
) -> DataFrame:
    """``carried`` in a struct ``row``, ``class_id``, ``class_size`` and ``stays``."""
    sketched = materialise(sketch(df, text, carried, weighting), "sketch")
    with_words = sketched.filter("text_id IS NOT NULL")
    nodes = materialise(with_words.groupBy("text_id").agg(F.min("row_id").alias("node")), "nodes")
    labels = classes(sketched, nodes, threshold)
    named_nodes = nodes.join(labels, "node", "left").select(
        "text_id", F.coalesce("label", "node").alias("label")
    )
    # Classes are settled on narrow rows; what is carried joins them at the end.
    rows = sketched.select("row_id", F.col(f"kept.`{key}`").alias("key"), "text_id")
    rows = rows.join(named_nodes, "text_id", "left").select(
        "row_id", "key", F.coalesce("label", "row_id").alias("label")
    )
    first = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "row_id"))
    groups = (
        rows.groupBy("label")
        .agg(first.alias("first"), F.count("*").alias("class_size"))
        .select(
            "label",
            F.col("first.key").alias("class_id"),
            F.col("first.row_id").alias("first_row"),
            "class_size",
        )
    )
    settled = rows.join(groups, "label").select(
        "row_id",
        "class_id",
        "class_size",
        (F.col("row_id") == F.col("first_row")).alias("stays"),
    )
    settled = materialise(settled, "classes")
    return join_by_key(
        sketched.select("row_id", F.col("kept").alias("row")), settled, ["row_id"]
    ).drop("row_id")
