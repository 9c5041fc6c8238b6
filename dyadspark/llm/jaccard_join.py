"""N-gram Jaccard join with token-combination prefixes.

A document's tokens are its distinct shingles of five words (``hashing.shingles``). Two documents link if 100 times the
size of the intersection is at least 75 times that of the union. The join is exact; it runs over sets, so equal sets are one node and
are not compared with each other.

Prefixes. A set of n tokens may lack at most e = floor(n / 4) of its tokens in a partner. All tokens stand in one order,
rare ones first, by a sketch of document counts of fixed size (``BUCKETS`` counters over all documents), then by hash. Tokens whose counter
stands far above the mean are the frequent class, the others the rare class.

- A rare token of the prefix is indexed by itself and counts 1.
- Frequent tokens are dealt to groups by hash and indexed in pairs of one group, so each group's first token counts 0 and every
  further one 1. The number of groups follows the size band of the smaller set of a pair: a set is indexed for its own band, and
  for the one below if a partner may be there.
- The prefix is extended until its count is e + 1. Of two linked sets, take the one whose prefix ends first: dropping the at most e
  tokens its partner lacks leaves a count of at least 1, so a rare token or a pair is in both prefixes. Sets of a band below
  ``PAIRED_FROM`` tokens use single tokens only.
- The sizes x and y of a pair ask for an overlap of o = ceil(3 (x + y) / 7), so that x lacks at most x - o tokens, which is
  mostly far less than e. The same argument with prefixes of this length holds, so one shared entry stands behind a count
  of at most x - o in the one set and y - o in the other. Entries carry the count before them as their place.

Candidates. An index entry of m sets is not expanded into m * m pairs. In round r the about 16**r sets of each entry with the
highest hash levels are compared with the others; links merge components after each round, and only sets of different
components are compared later. The last round has level 0, all sets, so no pair of different components is left out. Sizes and places
of the shared entry rule out pairs first, then the number of shared entries (a bound on the overlap), then the texts are compared
whole. Entries held by the same sets are merged before, so a shared passage is one entry and not one for each of its shingles.
Sets that share many entries would still meet at each of them. From the second round on a set names the first ``FIRSTS`` of its entries, by
their hash, and a pair is left out at an entry if both name a smaller one at which their sizes and places let them meet. The
smallest entry where they may meet is never left out, and the last round comes to all entries, so no pair is lost.

Null and empty texts and texts without words have no shingle, link with nothing and are their own component. Rows with equal doc_id are told
apart by their texts. A null doc_id takes part; a component of null ids alone has component_id null. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from dyadspark.llm.components import components
from dyadspark.llm.hashing import distinct_by_row, mix, row_sums, shingles, text_slices
from dyadspark.session import materialise, reads, release, small_batches

BUCKETS = 1 << 16
PAIRED_FROM = 16
#: Pivots of an entry grow by this power of two each round.
GROWTH = 4
#: Entries a set names so that a pair is not made again at later ones.
FIRSTS = 6
#: Bits of the filter that keeps documents no pair asks for out of a join's shuffle.
FILTER_BITS = 1 << 24
#: Bytes of text whose shingles a task computes at once.
_RUN_BYTES = 1 << 17


def _bucket(tokens: np.ndarray) -> np.ndarray:
    return (tokens >> np.uint64(48)).astype(np.int64)


def set_key(rows: np.ndarray, tokens: np.ndarray, n: int) -> np.ndarray:
    """One number for each row's set, the same for equal sets."""
    return mix(row_sums(mix(tokens), rows, n) + np.uint64(1))


def _sets(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, number of rows, row, token, key of each row) for runs of rows."""
    for first, data, offsets in text_slices(column, _RUN_BYTES):
        n = len(offsets) - 1
        rows, tokens = distinct_by_row(*shingles(data, offsets))
        yield first, n, rows, tokens, set_key(rows, tokens, n)


def digests_and_counts(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, key) of every row, and the sketch of token counts; one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, kind = np.zeros(BUCKETS, dtype=np.int64), None
        names = ["doc_id", "n", "key", "bucket"]
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for first, n, rows, tokens, key in _sets(batch.column("text")):
                counts += np.bincount(_bucket(tokens), minlength=BUCKETS)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(first, n), pa.array(np.bincount(rows, minlength=n).astype(np.int64)),
                     pa.array(key.view(np.int64)), pa.nulls(n, pa.int32())], names=names)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(used), kind), pa.array(counts[used]), pa.nulls(len(used), pa.int64()),
                 pa.array(used.astype(np.int32))], names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    both = materialise(
        docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, key long, bucket int"))
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for r in both.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        counts[r.bucket] = r.n
    return both.where("bucket IS NULL").select("doc_id", "n", "key"), counts


def frequent_from(counts: np.ndarray) -> float:
    """Counters above this hold a token far more frequent than the usual load of a counter explains."""
    mean = float(counts.mean())
    return mean + 6 * math.sqrt(mean) + 64


def bands(n: int) -> list[int]:
    """Size bands a set of n tokens is indexed for: its own, and the one below if a smaller partner may be there."""
    own = n.bit_length() - 1
    return [own] if -(-3 * n // 4) >= 1 << own else [own, own - 1]


def signatures(tokens: np.ndarray, counts: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """(entry, place) of one set; the place is the count that stands before the token, of a pair before its later one."""
    n = len(tokens)
    load = counts[_bucket(tokens)]
    order = np.lexsort((tokens, load))
    tokens, frequent = tokens[order], load[order] > limit
    need = n // 4 + 1
    rare = n - int(frequent.sum())
    if rare >= need:
        return tokens[:need], np.arange(need)
    out, places, single = [], [], 0
    for band in bands(n):
        if 1 << band < PAIRED_FROM:
            single = max(single, need)
            continue
        single = max(single, rare)
        groups = 1 << (band - 2)
        rest = tokens[rare:]
        group = (mix(rest + np.uint64(band)) % np.uint64(groups)).astype(np.int64)
        # a group's first token counts 0, each further one 1
        further = np.ones(len(rest), dtype=bool)
        further[np.unique(group, return_index=True)[1]] = False
        count = np.cumsum(further)
        stop = int(np.searchsorted(count, need - rare)) + 1
        order = np.argsort(group[:stop], kind="stable")
        rest, group, count = rest[order], group[order], count[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if b - a > 1:
                x, y = np.triu_indices(b - a, 1)
                out.append(mix(rest[a:b][x] + mix(rest[a:b][y] + np.uint64(band))))
                places.append(rare + count[a:b][y] - 1)
    return np.concatenate([tokens[:single], *out]), np.concatenate([np.arange(single), *places])


def postings(docs: DataFrame, loads: Broadcast) -> DataFrame:
    """``loads``: the sketch and the limit of its rare class. Returns entry, key, at: the index entries of every row's set; ``at`` packs the set's size and the place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, limit = loads.value
        for batch in batches:
            for _, n, rows, tokens, key in _sets(batch.column("text")):
                edges = np.searchsorted(rows, np.arange(n + 1)).tolist()
                entries, ats, keys = [], [], []
                for r in range(n):
                    size = edges[r + 1] - edges[r]
                    if size:
                        e, p = signatures(tokens[edges[r] : edges[r + 1]], counts, limit)
                        entries.append(e)
                        ats.append((size << 32) | p)
                        keys.append(np.full(len(e), key[r]))
                if entries:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(entries).view(np.int64)), pa.array(np.concatenate(keys).view(np.int64)),
                         pa.array(np.concatenate(ats).astype(np.int64))], names=["entry", "key", "at"])

    return docs.select("text").mapInArrow(run, "entry long, key long, at long")


def shared_entries(docs: DataFrame, loads: Broadcast) -> DataFrame:
    """entry, key, members, size, place, weight, level of the entries that at least two different sets have.

    Entries with the same sets, such as all shingles of a passage that the same documents share, become one entry: its
    weight is their number, and a set's place in it the first of its places in them.
    """
    # counted without the key, so that little is shuffled; entries of equal sets alone go below
    often = materialise(
        postings(docs, loads).groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry"))
    rows = materialise(postings(docs, loads).join(often, "entry").distinct())  # written in two steps: neither holds both shuffles
    release(often)
    held = rows.groupBy("entry").agg(
        F.count(F.lit(1)).alias("members"), F.bit_xor(F.xxhash64("key")).alias("who"),
        F.bit_xor(F.xxhash64("key", F.lit(1))).alias("who_too")).where("members > 1")
    same = held.select("entry", F.xxhash64("who", "who_too", "members").alias("one"), "members")
    merged = rows.join(same, "entry").groupBy("one", "members", "key").agg(
        F.count(F.lit(1)).cast("int").alias("weight"),
        F.first(F.shiftright("at", 32)).cast("int").alias("size"),
        F.min(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF))).cast("int").alias("place"))
    merged = merged.select(F.col("one").alias("entry"), "key", "members", "size", "place", "weight")
    index = materialise(merged.withColumn("level", level(F.col("key"))))
    release(rows)
    return index


def level(key: Column) -> Column:
    """Trailing zeros of the key's hash: level l has about one in 2**l keys."""
    h = F.xxhash64(key)
    return F.bit_count(h.bitwiseAND(-h) - 1)


def least_overlap(x: Column, y: Column) -> Column:
    """Smallest intersection of linked sets of these sizes: ceil(3 (x + y) / 7)."""
    return F.ceil((x + y) * 3 / 7)


def _meetings(live: DataFrame, turn: int) -> DataFrame:
    """Pairs of sets of different components that share an entry in which one is a pivot of this round; those that share several
    may come several times."""
    named = [c for c in ("first",) if c in live.columns]
    # pivots of round t: levels from ceil(log2(members)) - GROWTH * t on; earlier pivots have met all others
    top = F.ceil(F.log2(F.col("members")))
    low = F.greatest(top - GROWTH * turn, F.lit(0))
    before = F.greatest(top - GROWTH * (turn - 1), F.lit(0)) if turn else F.lit(64)
    rows = live.withColumns({"low": low, "before": before}).where(F.col("level") < F.col("before"))
    m = rows.select("entry", *[F.col(c).alias(f"{c}_m") for c in ("key", "label", "size", "place", "level", *named)])
    p = rows.where(F.col("level") >= F.col("low")).select(
        "entry", "low", *[F.col(c).alias(f"{c}_p") for c in ("key", "label", "size", "place", *named)])
    need = least_overlap(F.col("size_m"), F.col("size_p"))
    pairs = m.join(p, "entry").where(
        (F.col("label_m") != F.col("label_p"))
        & ((F.col("level_m") < F.col("low")) | (F.col("key_m") < F.col("key_p")))
        & (4 * F.least("size_m", "size_p") >= 3 * F.greatest("size_m", "size_p"))
        # some shared entry stands behind no more tokens than either set may lack
        & (F.col("place_m") <= F.col("size_m") - need) & (F.col("place_p") <= F.col("size_p") - need))
    if named:
        lack_m, lack_p = F.col("size_m") - need, F.col("size_p") - need
        pairs = pairs.where(~F.exists("first_m", lambda x: (x["entry"] < F.col("entry")) & (x["place"] <= lack_m) & F.exists(
            "first_p", lambda y: (y["entry"] == x["entry"]) & (y["place"] <= lack_p))))
    return pairs.select(F.least("key_m", "key_p").alias("a"), F.greatest("key_m", "key_p").alias("b"))


def _first() -> Column:
    """Aggregate of a set's index rows: the entries it names, with its places there. Sets of equal sizes may meet at all of them."""
    named = F.when(7 * F.col("place") <= F.col("size"), F.struct("entry", "place"))
    return F.slice(F.sort_array(F.collect_list(named)), 1, FIRSTS)


def _likely(pairs: DataFrame, lists: DataFrame) -> DataFrame:
    """Pairs whose shared entries leave the overlap possible.

    Let x be the set whose prefix ends first. All its tokens behind the prefix may be shared, of the prefix's rare tokens
    those that are shared entries, and of each group of frequent ones at most one more than it has shared pairs. As the
    prefix has one token more for each group, the groups cancel out, and the overlap is at most the number of shared
    entries plus size - floor(size / 4) - 1.
    """
    columns = F.struct("size", "entries", "weights")
    x = lists.select(F.col("key").alias("a"), columns.alias("x"))
    y = lists.select(F.col("key").alias("b"), columns.alias("y"))
    n, m = F.col("x.size"), F.col("y.size")
    behind = F.greatest(n - F.floor(n / 4) - 1, m - F.floor(m / 4) - 1)
    shared = F.aggregate(
        F.array_intersect("x.entries", "y.entries"), F.lit(0),
        lambda total, e: total + F.element_at(F.col("x.weights"), F.array_position(F.col("x.entries"), e).cast("int")))
    return pairs.join(x, "a").join(y, "b").where(shared >= least_overlap(n, m) - behind).select("a", "b")


def _slot(column: Column) -> Column:
    return F.xxhash64(column).bitwiseAND(F.lit(FILTER_BITS - 1))


def _listed(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition that every value of the one column of ``ids`` meets, and of other values few.

    Behind it stand ``FILTER_BITS`` bits, however many ids there are. With more ids more other values pass: it saves
    shuffled rows and is never the last word.
    """
    slot = _slot(F.col(ids.columns[0]))
    # a bit for each slot that an id has, eight to a byte
    used = ids.select(
        F.shiftright(slot, 3).alias("byte"),
        F.call_function("shiftleft", F.lit(1), slot.bitwiseAND(F.lit(7)).cast("int")).alias("bits"))
    used = used.groupBy("byte").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(FILTER_BITS >> 3, dtype=np.uint8)
    table[used.column("byte").to_numpy()] = used.column("bits").to_numpy()
    shared = ids.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf("boolean")
    def on(slots: pa.Array) -> pa.Array:
        at = slots.to_numpy(zero_copy_only=False)
        return pa.array((shared.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return lambda column: on(_slot(column))


def _texts(pairs: DataFrame, docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """(key, text) of the sets in the pairs; ``chosen``: key, doc. Other texts are not written, and few of them dealt."""
    keys = materialise(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct().join(chosen, "key"))
    asked = docs.select("doc_id", "text").where(_listed(keys.select("doc"))(F.col("doc_id")))
    return reads(_with_key(
        asked.join(keys, F.col("doc_id").eqNullSafe(F.col("doc"))).select("key", "text")), keys)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose sets, taken from the whole texts, meet the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 128):
                batch = whole.slice(i, 128)
                x, y = ([s for _, n, rows, tokens, _ in _sets(batch.column(c)) for s in _split(rows, tokens, n)]
                        for c in ("x", "y"))
                ok = []
                for s, t in zip(x, y):
                    both = len(np.intersect1d(s, t, assume_unique=True))
                    ok.append(100 * both >= 75 * (len(s) + len(t) - both))
                yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    x = texts.select(F.col("key").alias("a"), F.col("text").alias("x"))
    y = texts.select(F.col("key").alias("b"), F.col("text").alias("y"))
    return pairs.join(x, "a").join(y, "b").mapInArrow(run, "a long, b long").distinct()


def _split(rows: np.ndarray, tokens: np.ndarray, n: int) -> list[np.ndarray]:
    edges = np.searchsorted(rows, np.arange(n + 1)).tolist()
    return [tokens[a:b] for a, b in zip(edges[:-1], edges[1:])]


def jaccard_components(docs: DataFrame, limit: float | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id reachable by links) of every row.

    Tokens whose counter is above ``limit`` are the frequent class (default ``frequent_from``); it decides speed alone.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sets, counts = digests_and_counts(docs)
    loads = spark.sparkContext.broadcast((counts, frequent_from(counts) if limit is None else limit))
    index = shared_entries(docs, loads)
    lists = materialise(
        index.groupBy("key").agg(
            F.first("size").alias("size"), F.sort_array(F.collect_list(F.struct("entry", "weight"))).alias("e"), _first().alias("first"))
        .select("key", "size", "first", F.col("e.entry").alias("entries"), F.col("e.weight").alias("weights")))
    # one document for each set that shares an entry; equal ids with other texts are told apart by the set's key
    chosen = materialise(
        sets.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("doc")).join(lists.select("key"), "key"))
    labels = lists.select("key", F.col("key").alias("label"))
    live = reads(index.withColumn("label", F.col("key")), index)
    largest = index.agg(F.max("members")).first()[0] or 0
    turns = math.ceil(math.log2(largest) / GROWTH) + 1 if largest else 0
    for turn in range(turns):
        pairs = materialise(_likely(_meetings(live, turn).distinct(), lists))
        asked = _texts(pairs, docs, chosen)
        texts = materialise(asked)
        links = materialise(_linked(pairs, texts))
        release(pairs, asked, texts)
        if turn == turns - 1 and links.isEmpty():
            release(links)
            break
        merged = links.join(labels.select(F.col("key").alias("a"), F.col("label").alias("la")), "a").join(
            labels.select(F.col("key").alias("b"), F.col("label").alias("lb")), "b")
        found = components(merged.select(F.col("la").alias("a"), F.col("lb").alias("b")))
        joined = materialise(
            labels.join(found.withColumnRenamed("label", "new"), F.col("label") == F.col("node"), "left")
            .select("key", F.coalesce("new", "label").alias("label")))
        release(links, found, labels)
        labels = joined
        if turn < turns - 1:
            # entries whose sets are of one component are done
            now = live.drop("label").join(labels, "key")
            open_ = now.groupBy("entry").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where(
                F.col("lo") != F.col("hi")).select("entry")
            fewer = now.join(open_, "entry")
            fewer = materialise(fewer if turn else fewer.join(lists.select("key", "first"), "key"))
            release(live)
            live = fewer
    if turns:  # labels are written tables of their own by then, or there is no link at all
        labels = labels if turns > 1 else materialise(labels)
        release(lists, chosen, live)
    placed = sets.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    least = placed.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("least"))
    return placed.join(least, "label", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def _with_key(rows: DataFrame) -> DataFrame:
    """Of rows (key, text) those whose text's set has the key. Repeats of a row, which come one after another, are
    dropped; a repeat in another task stays and only doubles a comparison."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            keys = [key for *_, key in _sets(batch.column("text"))]
            own = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, dtype=np.int64)
            wanted = batch.column("key").to_numpy(zero_copy_only=False)
            keep = own == wanted
            for i in np.flatnonzero(keep).tolist():
                keep[i], last = wanted[i] != last, wanted[i]
            yield batch.filter(pa.array(keep))

    return rows.mapInArrow(run, "key long, text string")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (all columns) that stand first, by doc_id, in their component; rows of one doc_id stay together."""
    found = jaccard_components(docs).where(
        F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept_doc")).distinct()
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col("__kept_doc")), "left_semi")
