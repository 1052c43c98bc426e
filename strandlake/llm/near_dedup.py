"""Operator 9: near-duplicate classes by DartMinHash signatures."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from strandlake.llm.exchange import checkpointed, fresh
from strandlake.llm.kernels import Batch, U, Words, mix, portions, release, runs, thrifty

SHINGLE = 5
SIMILARITY = 0.8
#: 32 bands of 5 coordinates miss a pair of similarity 0.8 three times in a million.
BANDS, ROWS = 32, 5
#: Bytes of a text's sketch. A pair of similarity 0.8 agrees on less than SURE of it three times in a million.
SKETCH, SURE = 512, 0.72
#: Members of a bucket that one task compares with as many others.
BUCKET_BLOCK = 2048
#: Ways to choose a bucket's head: by how many texts it meets, else by a hash.
HEADS = 3
#: Widths of the rank cells below rank 1; cells above are of width 1.
FINE = 6
#: Cells looked at together, where sets have few elements.
CELLS = 1 << 15


def shingles(words: Words, row: int, to: int, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner (row - ``row``), hash and count of the distinct shingles of rows ``row`` to ``to``.

    A row with fewer words than ``width`` has one shingle of all its words; a row
    without words has none.
    """
    at = words.first[row]
    h = words.hash[at : words.first[to]]
    lengths = np.diff(words.first[row : to + 1])
    n = np.where(lengths >= width, lengths - width + 1, np.minimum(lengths, 1))
    start = runs(words.first[row:to] - at, n)
    owner = np.repeat(np.arange(to - row), n)
    last = (words.first[row + 1 : to + 1] - at)[owner]
    value = np.zeros(len(start), np.uint64)
    for k in range(width):
        place = start + k
        inside = place < last
        value = mix(value + np.where(inside, h[np.minimum(place, max(len(h) - 1, 0))], U(k))) if len(h) else value
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    return owner[first], value[first], np.diff(np.append(first, len(value)))


def _poisson(mean: float, most: int = 24) -> list[np.uint64]:
    """Values that a uniform 64-bit value is over if there are more than 0, 1, 2, ... darts."""
    below = np.cumsum([math.exp(-mean) * mean**k / math.factorial(k) for k in range(most)])
    return [U(min(int(x * 2.0**53) << 11 | 2047, (1 << 64) - 1)) for x in below]


_DARTS = {2.0**-j: _poisson(2.0**-j) for j in range(FINE + 1)}


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def _thrown(cell: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell and hash of each dart in cells of area ``width``."""
    at, darts, found = np.arange(len(cell)), [], []
    for turn, least in enumerate(_DARTS[width]):
        at = at[cell[at] > least] if turn else np.flatnonzero(cell > least)
        if not len(at):
            break
        found.append(at)
        darts.append(mix(cell[at] + U(turn + 1)))
    return (np.concatenate(found), np.concatenate(darts)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64))


def dart_signatures(owner: np.ndarray, element: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) coordinates for n weighted sets given as (owner, element, weight) rows.

    Over each element lies a plane of weight and rank on which hashed darts fall,
    one for each unit of area on average, in cells whose darts depend on the
    element and the cell alone.  A set is hit by the darts that fall below its
    element's weight.  Each dart belongs to one of the k coordinates, and a
    coordinate keeps its dart of the earliest rank; two sets keep the same one with
    the probability of their weighted Jaccard similarity.  Cells are looked at in
    the order of ranks, so only darts of empty coordinates matter, and a set is
    done when it has none.  Empty sets have zeros.
    """
    out, best = np.zeros(n * k, np.uint64), np.full(n * k, np.inf)
    # Cells of weight: one for each unit that the element's weight reaches into.
    layers = np.ceil(weight).astype(np.int64)
    own, w, layer = np.repeat(owner, layers), np.repeat(weight, layers), runs(np.zeros(len(layers), np.int64), layers)
    base = np.repeat(element, layers) + layer.astype(np.uint64) * U(0xD6E8FEB86659FD93)
    cut, number = bool((layer + 1 > w).any()), 0
    while len(own):
        # Once sets with few elements are left, many cells of width 1 are looked at together.
        many = 1 if number <= FINE else max(1, min(CELLS // len(own), number // 4))
        width = 1.0 if number > FINE else 2.0 ** -min(FINE, FINE + 1 - number)
        begin = float(number - FINE) if number > FINE else 0.0 if number == 0 else width
        later = np.repeat(np.arange(many, dtype=np.uint64), len(own))
        cell = mix((np.tile(base, many) if many > 1 else base) + (later + U(number)) * U(0x9FB21C651E98DF25))
        at, dart = _thrown(cell, width)
        e, begin = (at % len(own), begin + (at // len(own))) if many > 1 else (at, begin)
        place = own[e] * k + (mix(dart + U(4)) % U(k)).astype(np.int64)
        new = best[place] == np.inf
        if cut:
            new &= layer[e] + _unit(mix(dart + U(3))) < w[e]
        new = np.flatnonzero(new)
        place, dart = place[new], dart[new]
        rank = (begin[new] if many > 1 else begin) + width * _unit(mix(dart + U(2)))
        np.minimum.at(best, place, rank)
        first = best[place] == rank
        out[place[first]] = dart[first]
        number += many
        open_ = np.isinf(best.reshape(n, k)).any(1)[own]
        if not open_.all():
            own, base, w, layer = own[open_], base[open_], w[open_], layer[open_]
    return out.reshape(n, k)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _set_ids(owner: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """One number for each row's set of shingles, whatever their order."""
    total = np.zeros(n, np.uint64)
    np.add.at(total, owner, mix(value + U(9)))
    return mix(total + np.bincount(owner, minlength=n).astype(np.uint64))


def _chunks(words: Words, most: int = 1 << 17):
    row, n = 0, len(words.first) - 1
    while row < n:
        to = int(np.searchsorted(words.first, words.first[row] + most, side="right")) - 1
        to = min(max(to, row + 1), n, row + 256)
        yield row, to
        row = to


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int, rows: int, weighted: bool) -> DataFrame:
    """id, set_id, size and the bands' keys of every row."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("set_id", T.LongType()), T.StructField("size", T.LongType()), T.StructField("keys", T.ArrayType(T.LongType()))])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for record in (part for whole in batches for part in portions(whole, text_col)):
            batch = Batch(pa.Table.from_batches([record]), id_col, text_col)
            words = Words(batch, places=False)
            for row, to in _chunks(words):
                n = to - row
                owner, value, count = shingles(words, row, to)
                sig = dart_signatures(owner, value, count if weighted else np.ones(len(count), np.int64), n, bands * rows).reshape(n, bands, rows)
                key = np.tile(np.arange(bands, dtype=np.uint64), (n, 1))
                for r in range(rows):
                    key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                size = np.bincount(owner, minlength=n)
                has = size > 0
                offsets = np.concatenate([[0], np.cumsum(has * bands)]).astype(np.int32)
                keys = pa.ListArray.from_arrays(pa.array(offsets), _signed(key[has].ravel()))
                ids = batch.id_array().slice(row, n)
                yield pa.RecordBatch.from_arrays([ids.cast(arrow[0].type), _signed(_set_ids(owner, value, n)), pa.array(size), keys], schema=arrow)

    return docs.select(id_col, text_col).mapInArrow(thrifty(run), schema)


def _shingle_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """set_id, the set's shingles (in order, 5 bytes each) and its sketch: one byte of each of SKETCH dart coordinates."""

    def run(batches):
        for record in (part for whole in batches for part in portions(whole, text_col)):
            batch = Batch(pa.Table.from_batches([record]), id_col, text_col)
            words = Words(batch, places=False)
            for row, to in _chunks(words):
                owner, value, count = shingles(words, row, to)
                sketch = (dart_signatures(owner, value, np.ones(len(count), np.int64), to - row, SKETCH) & U(255)).astype(np.uint8)
                cut = np.searchsorted(owner, np.arange(to - row + 1))
                short = (value >> U(24)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                blobs = [short[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])]
                columns = [_signed(_set_ids(owner, value, to - row)), pa.array(blobs, pa.binary()), pa.array([x.tobytes() for x in sketch], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["set_id", "shingles", "sketch"])

    return docs.mapInArrow(thrifty(run), "set_id long, shingles binary, sketch binary")


def _across(table: pa.Table, similarity: float) -> pa.Table:
    """Pairs of a block of a bucket's strays and a block of its members that may be similar.

    Only pairs of different labels whose sketches agree enough, and only in the
    first band in which the two meet.
    """
    side = table.column("side").to_numpy()
    ids, label, size = (table.column(c).to_numpy() for c in ("set_id", "label", "size"))
    keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(len(ids), -1)
    key, out = table.column("key")[0].as_py(), []
    right = np.flatnonzero(side == 1)
    for i in np.flatnonzero(side == 0):
        j = right[(label[right] != label[i]) & (np.minimum(size[right], size[i]) >= similarity * np.maximum(size[right], size[i]))]
        if len(j):
            band = int(np.flatnonzero(keys[i] == key)[0])
            j = j[~(keys[j, :band] == keys[i, :band]).any(1)]
            j = j[(sketch[j] == sketch[i]).mean(1) >= SURE - 0.8 + similarity]
            out.append(np.stack([np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])]))
    a, b = np.concatenate(out, 1) if out else np.zeros((2, 0), np.int64)
    return pa.table([pa.array(a), pa.array(b)], names=["a", "b"])


def _similar(pairs: DataFrame, table: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets' Jaccard similarity is at least ``least``."""
    table = table.select("set_id", "shingles")
    right = table.withColumnRenamed("set_id", "b").withColumnRenamed("shingles", "sb")
    left = table.withColumnRenamed("set_id", "a").withColumnRenamed("shingles", "sa")

    def read(blob: bytes) -> np.ndarray:
        wide = np.zeros((len(blob) // 5, 8), np.uint8)
        wide[:, :5] = np.frombuffer(blob, np.uint8).reshape(-1, 5)
        return wide.view("<u8").ravel()

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa").to_pylist(), batch.column("sb").to_pylist()):
                x, y = read(x), read(y)
                both = np.sort(np.concatenate([x, y]))
                common = int((both[1:] == both[:-1]).sum())
                keep.append(common >= least * (len(both) - common) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return pairs.join(right, "b").join(left, "a").select("a", "b", "sa", "sb").mapInArrow(thrifty(run), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, label) with the least node of each connected component.

    Every round gives a node the least label around it, then the label of that
    label, until nothing changes; each round is checkpointed.
    """
    both = checkpointed(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = checkpointed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")).withColumn("label", F.least("node", "label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("new"))
        parent = step.select(F.col("node").alias("new"), F.col("new").alias("above"))
        after = step.join(parent, "new").select("node", F.least("new", "above").alias("next"), (F.least("new", "above") < F.col("label")).alias("moved"))
        after = checkpointed(after)
        labels = after.select("node", F.col("next").alias("label"))
        if not after.filter("moved").limit(1).count():
            return labels


def joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after further edges: only components that an edge joins are looked at again."""
    # A node that had no edge yet is a component of its own.
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).join(labels, "node", "left_anti").distinct()
    every = checkpointed(labels.select("node", "label").unionByName(nodes.withColumn("label", F.col("node"))))
    ends = edges.join(every.select(F.col("node").alias("a"), F.col("label").alias("la")), "a").join(every.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b")
    apart = ends.filter("la <> lb").select(F.col("la").alias("a"), F.col("lb").alias("b")).distinct()
    names = components(apart).select(F.col("node").alias("label"), F.col("label").alias("name"))
    return every.join(names, "label", "left").select("node", F.coalesce("name", "label").alias("label"))


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``set_id``, ``class_id``: one row for each row of ``docs``.

    Two texts are linked if the Jaccard similarity of their sets of five-word
    shingles is at least ``similarity``, checked on the sets; a class is a
    connected component, named by its least id (null if it has none).  Texts of
    the same set are one node, so copies cost nothing beyond their row.
    ``weighted`` draws candidates by shingle counts instead of presence.

    Null, empty and blank texts have no words and form one class.  Rows repeated in
    full are in one class.  A bucket compares its members to one of them, its head;
    heads are chosen in several ways, so large groups get several.  Buckets
    whose members are then in different components have the pairs across
    components checked as well, so no pair of a bucket is left undecided.
    """
    return _classified(docs, similarity, bands, rows, weighted, id_col, text_col).select("doc_id", "set_id", "class_id")


def _classified(docs: DataFrame, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, weighted: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with ``label``, which tells classes apart even where ids are repeated."""
    signed = checkpointed(signatures(docs, id_col, text_col, bands, rows, weighted))
    sets = signed.groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.min("size").alias("size"), F.any_value("keys").alias("keys"))
    members = sets.select("set_id", "size", "rep", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    found = checkpointed(members.join(shared, "key"))
    # The text that meets the most others is likely the one the others were made from.
    met = found.groupBy("set_id").agg(F.sum("n").alias("met"))
    turn = F.pmod(F.col("key"), F.lit(HEADS))
    rank = F.struct(F.when(turn == 0, F.col("met")).otherwise(F.xxhash64("set_id", turn)).alias("rank"), "set_id")
    hits = checkpointed(found.join(met, "set_id").withColumn("rank", rank))
    heads = hits.groupBy("key").agg(F.max("rank").getField("set_id").alias("head"))
    hits = checkpointed(hits.join(heads, "key").select("key", "set_id", "size", "rep", "head"))
    wanted = hits.select(F.col("rep").alias("_rep")).distinct()
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    table = checkpointed(_shingle_table(texts.join(wanted, F.col("_id").eqNullSafe(F.col("_rep")), "left_semi"), "_id", "_text").dropDuplicates(["set_id"]))
    stars = hits.filter("set_id <> head").select(F.least("head", "set_id").alias("a"), F.greatest("head", "set_id").alias("b")).distinct()
    links = checkpointed(_similar(stars, table, similarity))
    labels = components(links)
    labelled = checkpointed(hits.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").select("key", "set_id", "size", F.coalesce("label", "set_id").alias("label")))
    counts = labelled.groupBy("key", "label").agg(F.count("*").alias("n"))
    mixed = counts.groupBy("key").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("labels"), F.sum("n").alias("n")).filter("labels > 1").drop("labels")
    blocks = F.ceil(F.col("n") / BUCKET_BLOCK).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    within = labelled.join(mixed, "key").join(sets.select("set_id", "keys"), "set_id").join(table.select("set_id", "sketch"), "set_id")
    within = within.withColumn("own", F.pmod(F.xxhash64("set_id"), blocks).cast("int")).withColumn("other", every)
    columns = ["key", "set_id", "label", "size", "keys", "sketch"]
    strays = within.filter("label <> main").select(F.col("own").alias("i"), F.col("other").alias("j"), F.lit(0).alias("side"), *columns)
    others = within.select(F.col("other").alias("i"), F.col("own").alias("j"), F.lit(1).alias("side"), *columns)
    pairs = strays.unionByName(others).groupBy("key", "i", "j").applyInArrow(thrifty(lambda t: _across(t, similarity)), "a long, b long").distinct()
    more = checkpointed(_similar(pairs.join(stars, ["a", "b"], "left_anti"), table, similarity))
    if more.limit(1).count():
        labels = joined(labels, more)
    named = sets.select("set_id", "rep").join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
    names = named.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = named.join(names, "label").select("set_id", "class_id", "label")
    return signed.select("doc_id", "set_id").join(classes, "set_id").select("doc_id", "set_id", "class_id", "label")


def op9_near_dedup(docs: DataFrame) -> DataFrame:
    """Every document with the class of its near-duplicates."""
    return near_duplicates(docs).select("doc_id", "class_id")


@F.arrow_udf(T.LongType())
def _set_of(texts: pa.Array) -> pa.Array:
    record = pa.record_batch({"row": pa.array(np.arange(len(texts))), "text": texts})
    found = [np.zeros(0, np.uint64)]
    for part in portions(record, "text"):
        words = Words(Batch(pa.Table.from_batches([part]), "row", "text"), places=False)
        for row, to in _chunks(words):
            owner, value, _ = shingles(words, row, to)
            found.append(_set_ids(owner, value, to - row))
    release()
    return _signed(np.concatenate(found))


#: Else the join on the set would be pushed below the one on the id and hash every text again.
_set_of = _set_of.asNondeterministic()


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of ``docs`` (a documents table) for each class.

    It has the least id of its class (null only if the class has no other) and,
    where several rows of the class have that id, the least set and then the least
    hash of its content.  Other classes' rows of the same id don't count.
    """
    keep, set_, again, own = (fresh(docs, c) for c in ("_keep", "_set", "_again", "_own"))
    rows = checkpointed(_classified(docs).select("doc_id", "set_id", "label"))
    first = rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "set_id")).alias("_first"))
    leaders = first.select(F.col("_first.doc_id").alias(keep), F.col("_first.set_id").alias(set_))
    repeated = rows.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("doc_id").alias(again))
    same, led = F.col(keep).eqNullSafe(F.col(again)), F.col("doc_id").eqNullSafe(F.col(keep))
    # The set is only needed where an id has several rows.
    single = docs.join(leaders.join(repeated, same, "left_anti"), led, "left_semi")
    several = docs.join(leaders.join(repeated, same, "left_semi").select(keep).distinct(), led, "left_semi").withColumn(own, _set_of("text"))
    chosen = several.join(leaders, led & (F.col(own) == F.col(set_)), "left_semi")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    order = F.struct(F.sha2("text", 256), F.xxhash64(*columns))
    one = chosen.groupBy("doc_id", own).agg(F.min_by(F.struct(*columns), order).alias("_row")).select("_row.*")
    return single.unionByName(one)
