"""Near duplicates by SetSketch registers, banding and exact confirmation.

Two documents are linked if the Jaccard similarity of their sets of five-word
shingles is 0.75 or more. The steps:

1. One pass makes each document's set size, set key and sketch. Documents
   with the same set share a node, so copies cost nothing further.
2. The registers of a band form a bucket key. Each member of a bucket is paired
   with the bucket's smallest node: as many pairs as members.
3. A pair's similarity is estimated from its registers by maximum likelihood,
   given the known set sizes; pairs that may reach the threshold are confirmed
   on the full sets. Confirmed links give provisional components.
4. In a bucket whose other members still lie in different components these are
   compared across components, in blocks inside tasks: first by the registers,
   which leaves the members that may have a link, then on their full sets.
   Pairs never become rows; a group gives at most one link for each join.

A pair of similarity 0.75 shares no band of 50 with probability 1e-6, and is
refused by the estimate with one of 1e-6; a pair of 0.8 with 3e-9 and less.

Defined cases: a null or word-less text has an empty set and is linked with
nothing; a text of fewer than five words has its sequence as the one shingle;
a null id never becomes a component id unless all of its component are null;
repeated rows lie in one component. Other columns are not passed on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from depsignal.llm.components import components
from depsignal.llm.storage import written
from depsignal.llm.textarrays import mix, shingles, slices, words

BANDS, ROWS = 50, 5
REGISTERS = BANDS * ROWS
#: SetSketch parameters: base, rate and largest register value.
BASE, RATE, TOP = 1.001, 20.0, 65534
#: Members of a block; two blocks are compared at once.
BLOCK = 512
#: An estimate this far below the threshold, in standard deviations, rules a pair out.
DEVIATIONS = 5.0

_RANDOM = np.random.Generator(np.random.PCG64(977))
_FACTOR = _RANDOM.integers(0, 2**31, REGISTERS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFT = _RANDOM.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_LOG_BASE = np.log(BASE)

SKETCH = "doc_id long, n_shingles long, node long, registers binary"


def registers(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sketch of each set: how far its smallest exponential variate has fallen, in steps of the base.

    A row for each set, a register for each of REGISTERS hash functions. An empty set has zeros.
    """
    out = np.zeros((len(first) - 1, REGISTERS), np.uint16)
    full = np.flatnonzero(np.diff(first))
    if len(full):
        low = (values >> np.uint64(32)).astype(np.uint32)
        begin = first[full]
        least = np.empty((REGISTERS, len(full)), np.uint32)
        for k in range(REGISTERS):
            least[k] = np.minimum.reduceat(low * _FACTOR[k] + _SHIFT[k], begin)
        variate = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
        out[full] = np.clip(np.floor(1 - np.log(variate) / _LOG_BASE), 0, TOP + 1)
    return out


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of the union of two sets."""
    return np.maximum(a, b)


def _log_share(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / _LOG_BASE


def estimate(above: np.ndarray, below: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity, given in how many registers a exceeds b and b exceeds a, and both set sizes."""
    share = size_a / (size_a + size_b)
    top = np.minimum(share, 1 - share) / np.maximum(share, 1 - share)
    equal = REGISTERS - above - below

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        p = np.clip(_log_share(share - (1 - share) * j), 1e-12, 1)
        q = np.clip(_log_share((1 - share) - share * j), 1e-12, 1)
        return above * np.log(p) + below * np.log(q) + equal * np.log(np.clip(1 - p - q, 1e-12, 1))

    # the likelihood has one peak in j: narrow it down
    low, high = np.zeros_like(top), top.copy()
    for _ in range(30):
        third = (high - low) / 3
        left = log_likelihood(low + third) < log_likelihood(high - third)
        low, high = np.where(left, low + third, low), np.where(left, high, high - third)
    return (low + high) / 2


def _may_reach(threshold: float, ra: np.ndarray, rb: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Whether each pair's similarity may be the threshold or more."""
    na, nb = na.astype(float), nb.astype(float)
    found = np.zeros(len(ra), bool)
    floor = threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    # sizes this far apart can't reach it
    possible = np.flatnonzero(np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9)
    if len(possible):
        ra, rb = ra[possible], rb[possible]
        j = estimate((ra > rb).sum(1), (ra < rb).sum(1), na[possible], nb[possible])
        found[possible] = j >= floor
    return found


def _sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct shingles, sorted."""
    values, first = shingles(words(column))
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[first[:-1][first[:-1] < len(values)]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return values[keep], total[first]


def _keys(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A key of each set that depends on its members only."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values))])
    return mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64)).view(np.int64)


def _key_column(values: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.array(_keys(values, first), mask=np.diff(first) == 0)


def _binary(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(
        pa.binary(),
        len(rows),
        [None, pa.py_buffer((np.arange(len(rows) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(rows.tobytes())],
    )


def _rows(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, REGISTERS)


def sketches(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Set size, set key (null for an empty set) and sketch of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(1)):
                values, first = _sets(batch.column(1).slice(low, high - low))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, high - low).cast(pa.int64()),
                        pa.array(np.diff(first)),
                        _key_column(values, first),
                        _binary(registers(values, first)),
                    ],
                    names=["doc_id", "n_shingles", "node", "registers"],
                )

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, SKETCH)


def _bands(nodes: DataFrame) -> DataFrame:
    """(bucket, node) of every band of every node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                regs = _rows(part.column(1)).reshape(-1, BANDS, ROWS).astype(np.uint64)
                key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), regs.shape[:2])
                for k in range(ROWS):
                    key = mix(key * np.uint64(0x100000001B3) + regs[:, :, k])
                node = np.repeat(part.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(node)], names=["bucket", "node"])

    return nodes.select("node", "registers").mapInArrow(run, "bucket long, node long")


def _estimated(pairs: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose registers allow the threshold."""
    side = lambda end: nodes.select(F.col("node").alias(end), F.col("registers").alias(f"regs_{end}"), F.col("n_shingles").alias(f"n_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "regs_a", "regs_b", "n_a", "n_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                a, b, ra, rb, na, nb = batch.slice(at, 4096).columns
                keep = _may_reach(threshold, _rows(ra), _rows(rb), na.to_numpy(), nb.to_numpy())
                yield pa.RecordBatch.from_arrays([a.filter(pa.array(keep)), b.filter(pa.array(keep))], names=["a", "b"])

    return both.mapInArrow(run, "a long, b long")


def _dealt(members: DataFrame, payload: DataFrame) -> DataFrame:
    """Members (bucket, node, component) with their payload, dealt to groups (bucket, low, high) of bounded size.

    Members of the bucket's largest component are not compared with each
    other. The rest, and the largest component, are cut into blocks; a group
    is a block of the rest with itself, with another one or with one of the
    largest component. So a few outsiders of a large group cost as many copies of
    themselves as that group has blocks, and the group's members one each.
    """
    parts = members.groupBy("bucket", "component").count()
    whole = parts.groupBy("bucket").agg(
        F.max(F.struct("count", "component")).alias("largest"), F.sum("count").alias("size")
    )
    blocks = whole.select(
        "bucket",
        F.col("largest.component").alias("largest"),
        F.ceil(F.col("largest.count") / BLOCK).cast("long").alias("of_largest"),
        F.ceil((F.col("size") - F.col("largest.count")) / BLOCK).cast("long").alias("of_rest"),
    ).filter("of_rest > 0")
    inside, rest, number = F.col("component") == F.col("largest"), F.col("of_rest"), F.xxhash64("node")
    own = F.when(inside, rest + F.pmod(number, F.col("of_largest"))).otherwise(F.pmod(number, rest))
    others = F.when(inside, rest).otherwise(rest + F.col("of_largest"))
    return (
        members.join(blocks, "bucket")
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), others - 1)))
        .select("bucket", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "node", "component")
        .join(payload, "node")
    )


def _group(group: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Nodes, components, and which pairs of rows are to be compared in this group."""
    own, node, part = (group[c].to_numpy() for c in ("own", "node", "component"))
    low, high = group["low"][0].as_py(), group["high"][0].as_py()
    pairs = (own == low)[:, None] & (own == high)[None, :] & (part[:, None] != part[None, :])
    return node, part, np.triu(pairs) if low == high else pairs


def _hopeful(members: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The members that may reach the threshold with a member of another component of their bucket."""
    dealt = _dealt(members, nodes.select("node", "registers", "n_shingles"))
    least = (threshold - DEVIATIONS * np.sqrt(threshold * (1 - threshold) / REGISTERS)) * REGISTERS

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, _, pairs = _group(group)
        regs, size = _rows(group["registers"]), group["n_shingles"].to_numpy()
        hopeful = np.zeros(len(node), bool)
        for i in np.flatnonzero(pairs.any(1)).tolist():
            at = np.flatnonzero(pairs[i] if not hopeful[i] else pairs[i] & ~hopeful)
            # registers agree no less often than the sets do
            at = at[(regs[at] == regs[i]).sum(1) >= least]
            if len(at):
                at = at[_may_reach(threshold, np.broadcast_to(regs[i], (len(at), REGISTERS)), regs[at], np.broadcast_to(size[i], len(at)), size[at])]
                hopeful[at] = True
                hopeful[i] |= len(at) > 0
        bucket = group["bucket"].to_numpy()
        return pa.table({"bucket": bucket[hopeful], "node": node[hopeful]})

    return dealt.groupBy("bucket", "low", "high").applyInArrow(run, "bucket long, node long").distinct()


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share: products of their incidence, some thousand values at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    twice = count[place] > 1
    owner, place = owner[twice], (np.cumsum(count > 1) - 1)[place[twice]]
    order = np.argsort(place, kind="stable")
    owner, place = owner[order], place[order]
    total = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for low in range(0, int(place[-1]) + 1 if len(place) else 0, step):
        a, b = np.searchsorted(place, [low, low + step])
        seen = np.zeros((len(sets), step), np.float32)
        seen[owner[a:b], place[a:b] - low] = 1
        total += seen @ seen.T
    return total


def _linked(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components, confirmed on the full sets: as many of each group as join what its links join."""

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        node, part, pairs = _group(group)
        values = [np.asarray(v, np.int64) for v in group["shingles"].to_pylist()]
        size = np.array([len(v) for v in values])
        common = _common(values)
        links = pairs & (common * 100 >= (size[:, None] + size[None, :] - common) * percent)
        label, a, b = np.unique(part, return_inverse=True)[1], [], []
        for i in np.flatnonzero(links.any(1)).tolist():
            at = np.flatnonzero(links[i] & (label != label[i]))
            for other in np.unique(label[at], return_index=True)[1].tolist():
                j = at[other]
                a.append(min(node[i], node[j]))
                b.append(max(node[i], node[j]))
                label[label == label[j]] = label[i]
        return pa.table({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return _dealt(members, sets).groupBy("bucket", "low", "high").applyInArrow(run, "a long, b long").distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the whole texts of the documents ``lead`` that stand for them."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    lead = wanted.select("lead").distinct()
    rows = rows.join(lead, rows.doc_id.eqNullSafe(lead.lead), "left_semi").select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low, high in slices(batch.column(0)):
                values, first = _sets(batch.column(0).slice(low, high - low))
                sets = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.view(np.int64)))
                yield pa.RecordBatch.from_arrays([_key_column(values, first), sets], names=["node", "shingles"])

    made = rows.mapInArrow(run, "node long, shingles array<long>")
    return made.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"])


def _sets_of(ends: DataFrame, docs: DataFrame, nodes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(node, shingles) of the nodes in ``ends``, stored."""
    wanted = nodes.select("node", "lead").join(ends, "node", "left_semi")
    return written(_full_sets(docs, wanted, doc_id, text), "sets")


def _confirmed(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, percent: int, doc_id: str, text: str) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    sets = _sets_of(ends, docs, nodes, doc_id, text)
    side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"set_{end}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    common = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b") - common
    return written(both.filter(common * 100 >= total * percent).select("a", "b"), "links")


def _split_buckets(members: DataFrame, label: DataFrame) -> DataFrame:
    """(bucket, node, component) of the buckets whose members lie in more than one component."""
    placed = members.join(label, "node", "left").select("bucket", "node", F.coalesce("root", "node").alias("component"))
    several = placed.groupBy("bucket").agg(F.min("component").alias("least"), F.max("component").alias("most")).filter("least <> most")
    return placed.join(several.select("bucket"), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable by links, its own included) and kept."""
    threshold = percent / 100
    all_rows = written(sketches(docs, doc_id, text), "sketches")
    nodes = written(
        all_rows.filter("node is not null")
        .groupBy("node")
        .agg(F.min("doc_id").alias("lead"), F.first("n_shingles").alias("n_shingles"), F.first("registers").alias("registers")),
        "nodes",
    )
    bands = _bands(nodes)
    shared = bands.groupBy("bucket").agg(F.min("node").alias("leader"), F.max("node").alias("last")).filter("leader <> last")
    members = written(bands.join(shared.select("bucket", "leader"), "bucket"), "members")
    star = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    likely = written(_estimated(star, nodes, threshold), "pairs")
    links = _confirmed(likely, docs, nodes, percent, doc_id, text)

    others = members.filter("node <> leader").select("bucket", "node")
    label = components(links)
    split = written(_split_buckets(others, label), "split")
    hopeful = written(_hopeful(split, nodes, threshold), "hopeful")
    if hopeful.isEmpty():
        final = label
    else:
        sets = _sets_of(hopeful.select("node").distinct(), docs, nodes, doc_id, text)
        more = written(_linked(split.join(hopeful, ["bucket", "node"], "left_semi"), sets, percent), "links")
        final = components(links.unionByName(more))
    smallest = nodes.join(final, "node").groupBy("root").agg(F.min("lead").alias("component_id"))
    groups = nodes.join(final, "node", "left").join(smallest, "root", "left").select("node", F.coalesce("component_id", "lead").alias("component_id"))
    found = all_rows.select("doc_id", "n_shingles", "node").join(groups, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select(
        "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept")
    )
