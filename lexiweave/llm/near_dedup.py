"""Near-duplicate classes from bottom-k sketches made with one hash function.

1. Every text becomes its set of word shingles (64-bit hashes). Texts with the
   same set are one class from here on; its smallest id stands for it.
2. A class keeps the ``sketch`` smallest hashes of its set. The ``indexed``
   smallest of these go to inverted lists.
3. Lists of up to ``list_limit`` classes give all their pairs. In longer lists
   every class is paired with three hubs. Classes that these leave in different
   components are listed anew by the rarest values of their whole sketches, as
   many as two similar classes cannot both lack. Short ones of these lists give
   their pairs; in long ones there are three more hubs, and what is still apart
   meets on whole sets in blocks of the list (see ``_block_links``), so that no
   list is cut off and none is expanded in one task.
4. The union sketch of a pair estimates its similarity. Pairs that the
   estimate, with a margin of ``sigmas`` deviations, leaves possible are
   confirmed on the full sets; only confirmed pairs link.

Chances of missing a pair, at similarity 0.75: none of the ``indexed`` values is
shared, ``0.25 ** 24``, below 1e-14; and, for classes of more shingles than a
sketch holds, the estimate lies ``sigmas`` deviations off (step 4), or the
sketches share so many values fewer than expected (step 3), 3e-7 each at 5. A
larger similarity makes all of them smaller. ``EXACT`` has sketches that are
whole sets, so that nothing is left to chance, at the cost of sets in the lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiweave.llm.batches import bounded
from lexiweave.operators.components import connected_components
from lexiweave.runtime import Scratch, running_total_by_order


#: Ids of so many pairs, 16 bytes each, are broadcast to thin out the texts before these are shuffled; more are joined by a shuffle.
BROADCAST_PAIRS = 1_000_000
#: Pairs of one class that one task confirms; the text of that class is sent once for so many.
HUB_PAIRS = 500
#: Words whose hashes a task remembers.
CACHED_WORDS = 200_000
#: A task joins so many links at a time before it passes their forest on.
FOREST_EDGES = 500_000
#: Of the lists that come before one, a class carries so many, the nearest ones, to tell whom it has met.
MET_LISTS = 16


@dataclass(frozen=True)
class Params:
    """Production parameters; similarity is ``percent`` / 100."""

    words: int = 5
    percent: int = 75
    sketch: int = 128
    indexed: int = 24
    list_limit: int = 24
    block: int = 1024
    block_shingles: int = 1 << 19
    sigmas: float = 5.0


#: No estimate and no sampled value: every sketch is a whole set.
EXACT = Params(sketch=1 << 30, indexed=1 << 30)


class WordHashes(dict):
    """Hash of each word seen; emptied when it holds too many words. One task has one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            self[word] = h
        return h


_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, words: int = 5, hashes: WordHashes | None = None) -> np.ndarray:
    """Sorted distinct shingle hashes of a text, as positive int64.

    A text of fewer words is one shingle of all its words; no text or no word
    gives an empty set. Only A-Z is lower-cased; the six ASCII white-space
    characters separate words.
    """
    tokens = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not tokens:
        return np.empty(0, np.int64)
    known = WordHashes() if hashes is None else hashes
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    n = min(words, len(tokens))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, np.uint64(n), np.uint64)
        for i in range(n):
            out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(32)
    return np.unique((out >> np.uint64(1)).astype(np.int64))


def _sketches(k: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                sets = [shingle_set(t, words, hashes) for t in texts.slice(at, 256).to_pylist()]
                sigs = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(at, 256), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary()),
                        pa.array([s[:k] for s in sets], pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "n_shingles", "sig", "sketch"],
                )
    return run


def _confirm(words: int, percent: int):
    """Rows ``a, part, side, b, text`` in this order, a hub's text before its partners', to the pairs that hold on whole sets."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, group, hubs = WordHashes(), None, []
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
            sides, keep, texts = batch.column(2).to_pylist(), [], batch.column(4)
            for i, key in enumerate(keys):
                if key != group:
                    group, hubs = key, []
                own = shingle_set(texts[i].as_py(), words, hashes)
                if sides[i] == 0:
                    hubs.append(own)
                    keep.append(False)
                else:
                    shared = ((len(np.intersect1d(hub, own, assume_unique=True)), len(hub)) for hub in hubs)
                    keep.append(any(both > 0 and 100 * both >= percent * (n + len(own) - both) for both, n in shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))
    return run


def _estimated(pairs: DataFrame, reps: DataFrame, p: Params) -> DataFrame:
    """Pairs whose union sketch leaves the similarity possible; ``sure`` if the sketches are whole sets.

    ``est`` is the share of the smallest union values that both sketches hold.
    """
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(
        f"100 * least(n_a, n_b) >= {p.percent} * greatest(n_a, n_b)"
    )
    union = F.slice(F.array_sort(F.array_union("s_a", "s_b")), 1, p.sketch)
    whole = f"n_a <= {p.sketch} and n_b <= {p.sketch}"
    measured = sized.select(
        "a", "b", F.expr(whole).alias("sure"),
        F.when(F.expr(whole), F.array_union("s_a", "s_b")).otherwise(union).alias("u"),
        F.array_intersect("s_a", "s_b").alias("both"),
    ).select("a", "b", "sure", F.size("u").alias("size"), F.size(F.array_intersect("u", "both")).alias("shared"))
    s = p.percent / 100
    margin = F.when(F.col("sure"), F.lit(0.0)).otherwise(p.sigmas * F.sqrt(F.lit(s * (1 - s)) / F.col("size")))
    return measured.where((100 * F.col("shared") >= p.percent * F.col("size")) | (F.col("shared") / F.col("size") >= s - margin) & ~F.col("sure")).select(
        "a", "b", "sure", (F.col("shared") / F.col("size")).alias("est")
    )


def _forest(a: list[np.ndarray], b: list[np.ndarray], ids: np.ndarray, group: np.ndarray, earlier: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links between two blocks of whole sets, as few as join what they join.

    ``a`` comes first in ``ids``, ``group`` and ``earlier``; rows of one group
    are joined already, and rows with the same earlier list meet there.
    """
    sets, na = a + b, len(a)
    sizes = np.array([len(x) for x in sets])
    left = np.concatenate(a)
    by = np.argsort(left, kind="stable")
    left, rows = left[by], np.repeat(np.arange(na), sizes[:na])[by]
    right, at = np.concatenate(b), np.concatenate([[0], np.cumsum(sizes[na:])])
    low, high = np.searchsorted(left, right, "left"), np.searchsorted(left, right, "right")
    work = np.concatenate([[0], np.cumsum(high - low)])
    _, root = np.unique(group, return_inverse=True)
    root, out, first = root.copy(), [], 0
    while first < len(b):  # so many rows of b at a time that their common shingles fit
        last = first + 1
        while last < len(b) and work[at[last + 1]] - work[at[first]] <= 4_000_000 and last - first < 512:
            last += 1
        lo, n = low[at[first] : at[last]], (high - low)[at[first] : at[last]]
        place = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.empty(0, np.int64)
        mine = np.repeat(np.repeat(np.arange(last - first), sizes[na + first : na + last]), n)
        both = np.bincount(mine * na + rows[place], minlength=(last - first) * na).reshape(last - first, na)
        mine, own = slice(na + first, na + last), slice(0, na)
        ok = (both > 0) & (100 * both >= percent * (sizes[own][None, :] + sizes[mine][:, None] - both))
        ok &= (ids[own][None, :] != ids[mine][:, None]) & (earlier[own][None, :] != earlier[mine][:, None])
        ok &= group[own][None, :] != group[mine][:, None]
        for i, j in zip(*np.nonzero(ok), strict=True):
            x, y = root[j], root[na + first + i]
            if x != y:
                root[root == x] = y
                out.append((int(ids[j]), int(ids[na + first + i])))
        first = last
    return out


def _unmet(component: np.ndarray, met: list[np.ndarray], n: int) -> np.ndarray:
    """Which rows have a partner on the other side, in another component, with whom they share no list of ``met``.

    The first ``n`` rows are one side; if there are no others, they are both.
    """
    values, codes = np.unique(np.concatenate(met), return_inverse=True)
    rows = np.repeat(np.arange(len(met)), [len(x) for x in met])
    left, right = slice(0, n), slice(n, None) if n < len(met) else slice(0, n)
    apart = component[left][:, None] != component[right][None, :]
    for at in range(0, len(values), 2048):
        mine = (codes >= at) & (codes < at + 2048)
        on = np.zeros((len(met), min(2048, len(values) - at)), np.float32)
        on[rows[mine], codes[mine] - at] = 1
        apart &= on[left] @ on[right].T == 0
    out = np.zeros(len(met), bool)
    out[left] |= apart.any(1)
    out[right] |= apart.any(0)
    return out


def _block_links(members: DataFrame, sets: DataFrame, scratch: Scratch, p: Params) -> DataFrame:
    """Confirmed links ``(a, b)`` within long lists between classes still in different components.

    ``members(v, rep, n_shingles, component, earlier, met)``, ``earlier`` being
    the class's list before this one and ``met`` its nearest lists before. A
    list is dealt by component (small ones together), earlier list and size
    band into blocks of bounded size. Two blocks meet only if they are not of
    one component, not of one earlier list (there their classes met) and of
    bands that can be similar. Of two blocks, only the classes that have a
    partner not met in any list before get their whole sets. A task compares
    these and returns no more links than it has classes.
    """
    large = p.block // 4

    def labelled(df: DataFrame, column: str, label: str) -> DataFrame:
        """The column's value where so many share it that blocks of their own pay, else -1."""
        n = df.groupBy("v", column).agg(F.count("*").alias("__n"))
        return df.join(n, ["v", column]).withColumn(label, F.when(F.col("__n") >= large, F.col(column)).otherwise(F.lit(-1))).drop("__n")

    band = F.floor(F.log(F.col("n_shingles").cast("double")) / -float(np.log(p.percent / 100))).cast("int")
    placed = labelled(labelled(members, "component", "label"), "earlier", "before").withColumn("band", band)
    cells = placed.groupBy("v", "label", "before", "band").agg(
        F.ceil(F.greatest(F.count("*") / p.block, F.sum("n_shingles") / p.block_shingles)).cast("int").alias("parts")
    )
    placed = scratch.keep(
        placed.join(cells, ["v", "label", "before", "band"]).select(
            "v", "rep", "component", "earlier", "met",
            F.struct("label", "before", "band", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part")).alias("block"),
        ), "placed",
    )
    blocks = placed.groupBy("v", "block").agg(F.count("*").alias("n"))
    meets = blocks.select("v", F.col("block").alias("i")).join(blocks.select("v", F.col("block").alias("j")), "v").where(
        "i <= j and not (i.label = j.label and i.label <> -1) and not (i.before = j.before and i.before <> -1) and abs(i.band - j.band) <= 1"
    )
    # The narrow rows meet first; whole sets join last and cross to the comparing tasks once, those of a block that meets itself not twice.
    meets = scratch.keep(meets.withColumn("meet", F.monotonically_increasing_id()), "meets")
    cols = ["meet", "side", "rep", "component", "earlier", "met"]
    left = meets.join(placed.withColumnRenamed("block", "i"), ["v", "i"]).withColumn("side", F.lit(0)).select(cols)
    right = meets.where("i <> j").join(placed.withColumnRenamed("block", "j"), ["v", "j"]).withColumn("side", F.lit(1)).select(cols)

    def unmet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("side", kind="stable")
        return pdf[_unmet(pdf.component.to_numpy(), list(pdf.met), int((pdf.side == 0).sum()))].drop(columns="met")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "rep"], kind="stable")
        n = int((pdf.side == 0).sum())
        # Rows without an earlier list differ from each other.
        earlier = np.where(pdf.earlier == -1, -2 - np.arange(len(pdf)), pdf.earlier)
        sets, ids, group = list(pdf.shingles), pdf.rep.to_numpy(), pdf.component.to_numpy()
        if n == len(pdf):  # a block that meets itself
            sets, ids, group, earlier = sets * 2, np.tile(ids, 2), np.tile(group, 2), np.tile(earlier, 2)
        return pd.DataFrame(_forest(sets[:n], sets[n:], ids, group, earlier, p.percent), columns=["a", "b"], dtype="int64")

    narrow = left.union(right).groupBy("meet").applyInPandas(unmet, "meet long, side int, rep long, component long, earlier long")
    return scratch.keep(narrow, "unmet").join(sets, "rep").groupBy("meet").applyInPandas(compare, "a long, b long")


def _whole_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                texts = batch.column(1).slice(at, 256).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, 256), pa.array([shingle_set(t, words, hashes) for t in texts], pa.list_(pa.int64()))], names=["rep", "shingles"]
                )
    return run


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges to stars ``(u, v)`` with the same components, as far as the edges at hand tell; a lone loop stays one."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def stars() -> pa.RecordBatch:
        top = {x: find(x) for x in root}
        centres = {r for x, r in top.items() if x != r}
        kept = [(x, r) for x, r in top.items() if x != r or x not in centres]
        root.clear()
        return pa.RecordBatch.from_arrays([pa.array([k[i] for k in kept], pa.int64()) for i in (0, 1)], names=["u", "v"])

    seen = 0
    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = find(root.setdefault(u, u)), find(root.setdefault(v, v))
            root[max(p, q)] = min(p, q)
        seen += batch.num_rows
        if seen >= FOREST_EDGES:
            yield stars()
            seen = 0
    yield stars()


def _components(edges: DataFrame) -> DataFrame:
    """Components of links ``(a, b)`` between ids; each task joins the links it holds before they are shuffled."""
    return connected_components(edges, "a", "b", condense=lambda e: e.mapInArrow(_forests, "u long, v long"))


def _joined_up(found: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``found(node, component)`` after further links ``(a, b)``, which join whole components."""
    side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
    if links.isEmpty():
        return found
    moved = links.join(side("a"), "a", "left").join(side("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    joined = scratch.keep(_components(moved).withColumnRenamed("component", "to"), "joined")
    known = found.join(joined.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    # Ends that no earlier link had are nodes of their own until now.
    return scratch.keep(known.union(joined.select("node", "to")).groupBy("node").agg(F.min("component").alias("component")), "found")


def near_duplicates(docs: DataFrame, params: Params = Params(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``.

    ``component_id`` is the smallest id reachable over links, itself included;
    ``kept`` marks the row whose id it is. Null, empty and word-less texts have
    no shingles and no links. Rows that repeat an id share its links, and each
    comes back. A row with a null id has the component of the ids with the same
    text and is not kept; if there is none, its component is null, it is linked
    with nothing, and it is kept (``keep_one`` numbers such rows instead). An
    empty table gives an empty result; other columns are ignored.
    """
    p, scratch = params, Scratch(docs.sparkSession, "near")
    own = bounded(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sketched = own.mapInArrow(_sketches(p.sketch, p.words), "doc_id long, n_shingles long, sig binary, sketch array<long>")
    sketched = scratch.keep(sketched, "sketched")
    reps = scratch.keep(
        sketched.where("n_shingles > 0").groupBy("sig").agg(
            F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch")
        ), "classes",
    )
    members = sketched.select("doc_id", "n_shingles", "sig").join(reps.select("sig", "rep"), "sig", "left")

    values = reps.select("rep", "n_shingles", F.explode(F.slice("sketch", 1, p.indexed)).alias("v"))
    lengths = values.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    lists = scratch.keep(values.join(lengths, "v"), "lists")
    few, many = lists.where(F.col("length") <= p.list_limit), lists.where(F.col("length") > p.list_limit)

    def pairs_of(short: DataFrame) -> DataFrame:
        """All pairs of the classes of short lists, if their sizes let them be similar."""
        return short.select("v", F.col("rep").alias("a"), F.col("n_shingles").alias("n")).join(
            short.select("v", F.col("rep").alias("b"), F.col("n_shingles").alias("m")), "v"
        ).where(f"a < b and 100 * least(n, m) >= {p.percent} * greatest(n, m)").select("a", "b")

    close = pairs_of(few)
    # The hubs of a long list: the class whose values are the most common, the smallest one, and one by chance.
    many = scratch.keep(many.withColumn("central", F.sum("length").over(Window.partitionBy("rep"))), "long")

    def hubs_of(members: DataFrame, turn: int) -> DataFrame:
        return members.groupBy("v").agg(F.array_distinct(F.array(
            F.max(F.struct("central", -F.col("rep"), "rep"))["rep"], F.min(F.struct("n_shingles", "rep"))["rep"],
            F.min(F.struct(F.xxhash64("v", "rep", F.lit(turn)), "rep"))["rep"],
        )).alias("hubs"))

    starred = many.join(hubs_of(many, 1), "v").select("rep", F.explode("hubs").alias("hub")).where("rep <> hub").select(
        F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")
    )
    likely = scratch.keep(_estimated(close.union(starred).distinct(), reps, p), "likely")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Those of the pairs that hold on full sets; whole sketches are full sets already."""
        sure, open_ = pairs.where("sure").select("a", "b"), scratch.keep(pairs.where("not sure").select("a", "b"), "open")
        ids = open_.select(F.col("a").alias("doc_id")).union(open_.select(F.col("b").alias("doc_id"))).distinct()
        ids = F.broadcast(ids) if open_.count() <= BROADCAST_PAIRS else ids
        texts = own.join(ids, "doc_id", "left_semi")
        # A hub's text goes to each part of its pairs once, not to each pair.
        parts = open_.groupBy("a").agg(F.ceil(F.count("*") / HUB_PAIRS).cast("int").alias("parts"))
        placed = scratch.keep(open_.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b"), "parts")
        hubs = placed.select("a", "part").distinct().join(texts.withColumnRenamed("doc_id", "a"), "a").select("a", "part", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
        others = placed.join(texts.withColumnRenamed("doc_id", "b"), "b").select("a", "part", F.lit(1).alias("side"), "b", "text")
        dealt = hubs.union(others).repartition("a", "part").sortWithinPartitions("a", "part", "side")
        return scratch.keep(sure.union(dealt.mapInArrow(_confirm(p.words, p.percent), "a long, b long")), name)

    def across(pairs: DataFrame, found: DataFrame) -> DataFrame:
        """Pairs whose ends are not yet in one component."""
        side = lambda x: found.select(F.col("node").alias(x), F.col("component").alias(f"c_{x}"))
        return pairs.join(side("a"), "a", "left").join(side("b"), "b", "left").where(
            "coalesce(c_a, a) <> coalesce(c_b, b)"
        ).select(*pairs.columns)

    # The likeliest pair of each class first: what those connect need not be confirmed pair by pair.
    first = likely.groupBy("b").agg(F.max_by(F.struct("a", "sure", "est"), F.struct("est", -F.col("a"))).alias("x")).select("x.a", "b", "x.sure", "x.est")
    found = scratch.keep(_components(confirmed(first, "first")), "found")
    found = _joined_up(found, confirmed(across(likely, found), "second"), scratch)

    def still_apart(lists: DataFrame, found: DataFrame) -> DataFrame:
        """The lists that hold several components, with the largest one of each."""
        placed = lists.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        held = placed.groupBy("v", "component").agg(F.count("*").alias("n"))
        held = held.groupBy("v").agg(F.max(F.struct("n", "component"))["component"].alias("largest"), F.count("*").alias("parts")).where("parts > 1")
        return placed.join(held, "v")

    # Long lists: what the hubs left apart. Two classes of it that are similar share at least ``least`` values of their whole
    # sketches, so they share one of those that remain of each when all but ``least - 1`` of its values, the commonest ones, are taken off.
    left = still_apart(many.select("v", "rep"), found).select("rep").distinct()
    values = scratch.keep(reps.join(left, "rep").select("rep", "n_shingles", F.explode("sketch").alias("v")), "values")
    size, share = F.size("by"), p.percent / 100
    sampled = F.floor(size * share - p.sigmas * F.sqrt(size * (share * (1 - share))))
    least = F.greatest(F.lit(1), F.when(100 * F.col("n_shingles") <= p.percent * p.sketch, F.ceil(size * p.percent / 100)).otherwise(sampled))
    ranked = values.join(values.groupBy("v").agg(F.count("*").alias("n")), "v").groupBy("rep").agg(
        F.sort_array(F.collect_list(F.struct("n", "v"))).alias("by"), F.first("n_shingles").alias("n_shingles")
    )
    rare = scratch.keep(ranked.select("rep", "n_shingles", F.explode(F.slice("by", F.lit(1), (size - least + 1).cast("int"))).alias("x")).where("x.n > 1").select("rep", "n_shingles", F.col("x.v").alias("v")), "rare")
    lengths = rare.groupBy("v").agg(F.count("*").alias("length")).where("length > 1")
    rare = scratch.keep(rare.join(lengths, "v"), "rare_lists")
    close, rare = pairs_of(rare.where(F.col("length") <= p.list_limit)), rare.where(F.col("length") > p.list_limit)
    by, at = F.sort_array(F.collect_list(F.struct("length", "v"))), F.col("at")
    rare = rare.groupBy("rep").agg(by.alias("by"), F.first("n_shingles").alias("n_shingles"), F.sum("length").alias("central")).select(
        "rep", "n_shingles", "central", "by", F.posexplode("by").alias("at", "key")
    ).select("rep", "n_shingles", "central", F.col("key.v").alias("v"), F.when(at > 0, F.get("by", at - 1)["v"]).otherwise(F.lit(-1)).alias("earlier"),
             F.slice("by.v", F.greatest(at - MET_LISTS + 1, F.lit(1)), F.least(at, F.lit(MET_LISTS))).alias("met"))
    rare = scratch.keep(rare, "rare_long")

    # Once more with short lists, and with hubs from outside the largest component of each long one.
    apart = scratch.keep(still_apart(rare, found), "apart")
    rest = hubs_of(apart.where("component <> largest"), 2)
    again = apart.join(rest, "v").select("rep", "component", F.explode("hubs").alias("hub")).where("rep <> hub").select(
        F.least("rep", "hub").alias("a"), F.greatest("rep", "hub").alias("b")
    )
    likely = scratch.keep(_estimated(across(close.union(again).distinct(), found), reps, p), "likely2")
    found = _joined_up(found, confirmed(likely, "third"), scratch)

    # And what is left, block by block, on whole sets.
    apart = scratch.keep(still_apart(rare, found).select("v", "rep", "n_shingles", "component", "earlier", "met"), "apart")
    ids = apart.select(F.col("rep").alias("doc_id")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_PAIRS else ids
    sets = own.join(ids, "doc_id", "left_semi").mapInArrow(_whole_sets(p.words), "rep long, shingles array<long>")
    found = _joined_up(found, scratch.keep(_block_links(apart, sets, scratch, p), "fourth"), scratch)
    joined = members.join(found.withColumnRenamed("node", "rep"), "rep", "left")
    return joined.select(
        "doc_id", "n_shingles", F.coalesce("component", "rep", "doc_id").alias("component_id")
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, params: Params = Params()) -> DataFrame:
    """The rows of ``docs`` whose id stands for its group; columns as they came.

    Of rows that repeat a kept id, all stay. Rows with a null id are documents
    of their own that count as larger than all ids: one row of a group that
    has no other stays too.
    """
    spark, unnamed, rows = docs.sparkSession, docs.where("doc_id is null"), docs.withColumn("__id", F.col("doc_id"))
    if not unnamed.isEmpty():
        scratch = Scratch(spark, "unnamed")
        named, high = docs.where("doc_id is not null"), docs.agg(F.coalesce(F.max("doc_id"), F.lit(0))).first()[0]
        if high >= 1 << 62:  # no room above: ids make way for their places in their order
            places = running_total_by_order(named.select("doc_id").distinct(), ["doc_id"], "__id")
            places = scratch.keep(places, "places")
            high = places.count()
            rows = named.join(places, "doc_id").select(*docs.columns, "__id")
        else:
            rows = rows.where("doc_id is not null")
        # The numbers are not the same each time they are computed, so they are written once.
        numbered = scratch.keep(unnamed.withColumn("__id", F.monotonically_increasing_id() + F.lit(high + 1)), "numbered")
        rows = rows.unionByName(numbered)
    kept = near_duplicates(rows, params, "__id").where("kept").select(F.col("doc_id").alias("__kept")).distinct()
    return rows.join(kept, rows["__id"] == kept["__kept"], "left_semi").drop("__id")
