"""TF-IDF as relations: exploded terms, document frequencies, weights of unit length, cosine pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from newsloom.session import settled

TOKEN = r"(?U)\w\w+"
#: Cells of dense vectors and vectors of a block.
CELLS, BLOCK = 64, 2048
#: Rows of a prefix term that meet the others in one group of cosine_pairs.
PREFIX_ROWS = 2000
#: Copies that one row of short_pairs stands for.
COPIES = 512
#: Vectors of a block of long_pairs, blocks that there are at least where there are as many vectors, and rows multiplied at a time.
LONG_BLOCK, LEAST_BLOCKS, STRIP = 4096, 16, 512
#: Counters of frequent_terms' sketch.
COUNTERS = 1 << 22
#: Words that a task counts at a time, unless one text has more.
STEP = 1 << 19


def stop_words() -> list[str]:
    """Spark's English list, as lower-case terms of the tokenizer (its apostrophes part words)."""
    return sorted({part for w in StopWordsRemover.loadDefaultStopWords("english") for part in w.split("'") if len(part) > 1})


def _tokens(docs: DataFrame, text: str, keep: list[str], stop: list[str]) -> DataFrame:
    """`keep` columns of docs and w, the words of two letters or more without stop words."""
    tokens = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))
    return docs.select(*keep, (F.filter(tokens, lambda w: ~w.isin(*stop)) if stop else tokens).alias("w"))


def _pairs() -> Column:
    """Pairs of neighbours in w."""
    pairs = F.zip_with(F.slice("w", 1, F.greatest(F.lit(0), F.size("w") - 1)), F.slice("w", 2, F.greatest(F.lit(0), F.size("w") - 1)), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size("w") > 1, pairs).otherwise(F.array().cast("array<string>"))


def terms(docs: DataFrame, key: str, text: str, stop: list[str] = (), bigrams: bool = False, known: DataFrame | None = None) -> DataFrame:
    """key, term, tf: words of two letters or more, without stop words, and pairs of neighbours among those.

    known: a vocabulary of bounded size; with it only its terms are counted, where the texts are, with its other columns, and no
    other term is shuffled. The result is dealt by key."""
    held = _tokens(docs, text, [key], stop)
    if known is not None:
        return _known_terms(held, key, known, bigrams)
    if bigrams:
        held = held.select(key, F.concat("w", _pairs()).alias("w"))
    return held.select(key, F.explode("w").alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _steps(batches: Iterator[pa.RecordBatch], column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, pa.Array]]:
    """Parts of batches of about STEP words at most, with each word's row, its number, and the words by number."""
    for batch in batches:
        ends, first = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy()), 0
        while first < len(batch):
            most = (ends[first - 1] if first else 0) + STEP
            last = max(first + 1, int(np.searchsorted(ends, most, side="right")))
            part = batch.slice(first, last - first)
            sizes = pc.fill_null(pc.list_value_length(part.column(column)), 0).to_numpy()
            words = part.column(column).flatten().dictionary_encode()
            yield part, np.repeat(np.arange(len(part)), sizes), words.indices.to_numpy().astype(np.int64), words.dictionary
            first = last


def _neighbours(rows: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The rows, and both words, of neighbours in a row."""
    near = rows[1:] == rows[:-1]
    return rows[1:][near], codes[:-1][near], codes[1:][near]


def _tally(rows: np.ndarray, codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and occurrences of each number below size."""
    return np.bincount(np.unique(rows * size + codes) % size, minlength=size), np.bincount(codes, minlength=size)


def _slots(names: pa.Array, a: np.ndarray, b: np.ndarray, counters: int) -> np.ndarray:
    """A counter for each pair of words, by their texts alone."""
    digest = pd.util.hash_array(names.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(names) else np.zeros(0, np.uint64)
    mixed = digest[a] * np.uint64(0x9E3779B97F4A7C15) ^ (digest[b] >> np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return ((mixed >> np.uint64(20)) % np.uint64(counters)).astype(np.int64)


def _joined(names: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    return pc.binary_join_element_wise(names.take(pa.array(a)), names.take(pa.array(b)), " ")


def _lookup(table: pa.Table, bigrams: bool):
    """A function from batches (key, w) to their parts, and with each the rows, numbers in table and occurrences of the terms that it holds,
    by row."""
    terms = table.column("term").combine_chunks()
    first, second = (pa.array([t.split(" ", 1)[side] if " " in t else None for t in terms.to_pylist()], pa.string()) for side in (0, 1))
    single = np.array([" " not in t for t in terms.to_pylist()], bool)
    words = pc.unique(pa.concat_arrays([terms.cast(pa.string()).filter(pa.array(single)), first.drop_null(), second.drop_null()]))
    number = lambda of: pc.fill_null(pc.index_in(of.cast(pa.string()), value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    size = len(words) + 1
    # a word's own number, with -1 as its partner, or both words' numbers: one key a term, in ascending order
    keys = np.where(single, (number(terms) + 1) * size, (number(first) + 1) * size + number(second) + 1)
    order = np.argsort(keys)
    keys = keys[order]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
        for part, rows, codes, names in _steps(batches, 1):
            at = number(names)[codes] + 1 if len(codes) else codes
            found, owner = at * size, rows
            if bigrams:
                row, a, b = _neighbours(rows, at)
                both = (a > 0) & (b > 0)
                found, owner = np.concatenate([found, (a * size + b)[both]]), np.concatenate([rows, row[both]])
            place = np.searchsorted(keys, found)
            hit = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == found) if len(keys) else np.zeros(len(found), bool)
            seen, times = np.unique(owner[hit] * max(len(keys), 1) + place[hit], return_counts=True)
            row, term = np.divmod(seen, max(len(keys), 1))
            yield part, row, order[term], times.astype(np.int64)

    return look


def _known_terms(held: DataFrame, key: str, known: DataFrame, bigrams: bool) -> DataFrame:
    """key, known's columns, tf of held (key, w); the vocabulary is looked up as arrays in tasks."""
    table = known.toArrow()  # of bounded size
    look = _lookup(table, bigrams)
    fields = [held.schema[key], *known.schema.fields]
    schema = StructType([*fields, StructField("n", held.selectExpr("1L as n").schema["n"].dataType)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, term, times in look(batches):
            taken = table.take(pa.array(term)).combine_chunks()
            columns = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in taken.columns]
            yield pa.record_batch([part.column(0).take(pa.array(row)), *columns, pa.array(times)], names=schema.names)

    counted = held.select(key, "w").mapInArrow(count, schema).repartition(F.col(key))
    return counted.groupBy(key, *known.columns).agg(F.sum("n").alias("tf"))


def known_vectors(docs: DataFrame, key: str, text: str, stop: list[str], known: DataFrame, documents: int, bigrams: bool = False, sublinear: bool = False) -> DataFrame:
    """key, at, w: for each key the vector of `terms` and `weigh` over a vocabulary (term, df, at) of bounded size, as arrays in ascending `at`.

    A row is counted and a key weighed as arrays in tasks; what is shuffled are a row's counts, as one row."""
    table = known.toArrow()  # of bounded size
    places, df = table.column("at").to_numpy().astype(np.int32), table.column("df").to_numpy().astype(float)
    rarity = np.zeros(int(places.max(initial=-1)) + 1)
    rarity[places] = np.log((1 + documents) / (1 + df)) + 1
    look = _lookup(table, bigrams)
    name = docs.schema[key].dataType.simpleString()

    def lists(rows: np.ndarray, size: int, values: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=size))]), pa.int32()), pa.array(values))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, term, times in look(batches):
            yield pa.record_batch([part.column(0), lists(row, len(part), places[term]), lists(row, len(part), times)], names=["key", "at", "n"])

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.repeat(np.arange(len(batch)), pc.list_value_length(batch.column(1)).to_numpy())
            at, n = (batch.column(i).flatten().to_numpy() for i in (1, 2))
            cells, inverse = np.unique(rows * max(len(rarity), 1) + at, return_inverse=True)  # a key of several rows has a place several times
            row, place = np.divmod(cells, max(len(rarity), 1))
            tf = np.bincount(inverse, n, len(cells))
            w = (1 + np.log(tf) if sublinear else tf) * rarity[place]
            w /= np.sqrt(np.bincount(row, w * w, len(batch)))[row]
            yield pa.record_batch([batch.column(0), lists(row, len(batch), place.astype(np.int32)), lists(row, len(batch), w)], names=["key", "at", "w"])

    counted = _tokens(docs.where(F.col(key).isNotNull()), text, [key], stop).mapInArrow(count, f"key {name}, at array<int>, n array<long>")
    by = counted.groupBy("key").agg(F.collect_list(F.struct("at", "n")).alias("l")).select("key", F.flatten("l.at").alias("at"), F.flatten("l.n").alias("n"))
    return by.mapInArrow(weighed, f"key {name}, at array<int>, w array<double>").withColumnRenamed("key", key)


def frequent_terms(docs: DataFrame, text: str, stop: list[str] = (), most_terms: int = 5000, least_docs: int = 2, counters: int = COUNTERS) -> DataFrame:
    """term, df of the most_terms most frequent words and pairs, just as `vocabulary` of `terms` with bigrams gives them.

    Words are counted first; the least frequent of the most_terms best words is a floor for all terms. Pairs are added up by
    a hash into so many counters, and none whose counter stays below the floor can be among the best. Only the others, a small
    part of all pairs, are counted by name, exactly. Tasks count steps of texts as arrays; their counts are added up by term."""
    held = _tokens(docs, text, [], stop)
    counts = lambda names, df, cf: pa.record_batch([names.cast(pa.string()), pa.array(df.astype(np.int64)), pa.array(cf.astype(np.int64))], names=["term", "df", "cf"])

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows, codes, names in _steps(batches):
            yield counts(names, *_tally(rows, codes, len(names)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(counters, np.int64)
        for _, rows, codes, names in _steps(batches):
            _, a, b = _neighbours(rows, codes)
            total += np.bincount(_slots(names, a, b, counters), minlength=counters)
        slot = np.flatnonzero(total)
        for i in range(0, len(slot), 1 << 16):
            yield pa.record_batch([pa.array(slot[i : i + (1 << 16)].astype(np.int32)), pa.array(total[slot[i : i + (1 << 16)]])], names=["slot", "n"])

    added = lambda rows: rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf")).where(F.col("df") >= least_docs)
    best = settled(added(held.mapInArrow(words, "term string, df long, cf long")).orderBy(F.desc("cf"), "term").limit(most_terms))
    seen = best.agg(F.count("*").alias("n"), F.min("cf").alias("least")).first()
    floor = seen["least"] if seen["n"] == most_terms else least_docs
    full = held.mapInArrow(sketch, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).where(F.col("n") >= floor).select("slot").toArrow()  # no more rows than counters
    marks = np.zeros(counters, bool)
    marks[full.column("slot").to_numpy()] = True
    sent = docs.sparkSession.sparkContext.broadcast(np.packbits(marks))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able = np.unpackbits(sent.value, count=counters).astype(bool)
        for _, rows, codes, names in _steps(batches):
            row, a, b = _neighbours(rows, codes)
            kept = able[_slots(names, a, b, counters)]
            both, inverse = np.unique(a[kept] * len(names) + b[kept], return_inverse=True)
            if len(both):
                yield counts(_joined(names, *np.divmod(both, len(names))), *_tally(row[kept], inverse, len(both)))

    counted = added(held.mapInArrow(pairs, "term string, df long, cf long"))
    return best.unionByName(counted).orderBy(F.desc("cf"), "term").limit(most_terms).select("term", "df")


def vocabulary(counts: DataFrame, least_docs: int = 2, most_terms: int | None = None) -> DataFrame:
    """term, df: terms of enough documents; the most_terms most frequent, by name on ties."""
    by = counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf")).where(F.col("df") >= least_docs)
    return (by if most_terms is None else by.orderBy(F.col("cf").desc(), "term").limit(most_terms)).select("term", "df")


def weigh(counts: DataFrame, key: str, documents: int, sublinear: bool = False) -> DataFrame:
    """counts (key, tf, df, ...) without tf and df, with w: tf (or 1 + ln tf) times ln((1 + n) / (1 + df)) + 1, divided by the document's length."""
    tf = 1 + F.log("tf") if sublinear else F.col("tf")
    raw = counts.withColumn("w", tf * (F.log((1 + F.lit(documents)) / (1 + F.col("df"))) + 1)).drop("tf", "df")
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key)))
    return raw.withColumn("w", F.col("w") / length)


def weights(counts: DataFrame, vocab: DataFrame, key: str, documents: int, sublinear: bool = False) -> DataFrame:
    """key, term, w of counts (key, term, tf)."""
    return weigh(counts.join(vocab, "term"), key, documents, sublinear).select(key, "term", "w")


def cosine_pairs(weighted: DataFrame, key: str, least: float) -> DataFrame:
    """a, b (a < b), cosine above `least` of unit vectors (key, term, w).

    Exact prefix filtering: with terms in one order, rarest first, a vector's prefix ends where what follows is
    shorter than `least`. Vectors that share no prefix term have a smaller cosine, so candidates come from an
    equi-join on prefix terms, which the commonest terms hardly ever are. From the first term that two vectors share on,
    their cosine is at most the product of its weights plus that of the lengths of what follows it in both; pairs for which that
    is too little are dropped in the join. A prefix term of many vectors is dealt to groups of PREFIX_ROWS of
    them, each of which meets all of them, so no group grows with the term. Full cosines follow for candidates."""
    frequency = weighted.groupBy("term").agg(F.count("*").alias("df"))
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key).orderBy("df", "term").rowsBetween(0, Window.unboundedFollowing))
    prefix = weighted.join(frequency, "term").withColumn("rest", rest).where(F.col("rest") >= (1 - 1e-9) * least * least).select(key, "term", "w", F.sqrt(F.greatest(F.lit(0.0), F.col("rest") - F.col("w") * F.col("w"))).alias("after"))
    groups = prefix.groupBy("term").agg(F.ceil(F.count("*") / PREFIX_ROWS).cast("int").alias("groups"))
    dealt = prefix.join(groups, "term")
    a = dealt.select(F.col(key).alias("a"), "term", F.pmod(F.xxhash64(key), "groups").cast("int").alias("group"), F.col("w").alias("wa"), F.col("after").alias("after_a"))
    b = dealt.select(F.col(key).alias("b"), "term", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"), F.col("w").alias("wb"), F.col("after").alias("after_b"))
    enough = F.col("wa") * F.col("wb") + F.col("after_a") * F.col("after_b") >= least - 1e-9
    candidates = a.join(b, ["term", "group"]).where((F.col("a") < F.col("b")) & enough).select("a", "b").distinct()
    left, right = (weighted.select(F.col(key).alias(side), "term", F.col("w").alias(f"w{side}")) for side in ("a", "b"))
    met = candidates.join(left, "a").join(right, ["b", "term"])
    return met.groupBy("a", "b").agg(F.sum(F.col("wa") * F.col("wb")).alias("cosine")).where(F.col("cosine") > least)


def copies(counts: DataFrame, key: str) -> DataFrame:
    """bag, n, first, keys of counts (key, term, tf): a row for each different bag of terms, with the rows that hold it, the smallest key
    and all keys but null. A copy costs the length of its key."""
    bags = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("term", "tf"))).alias("bag"))
    return bags.groupBy("bag").agg(F.count("*").alias("n"), F.min(key).alias("first"), F.collect_list(key).alias("keys"))


def short_pairs(weighted: DataFrame, key: str, least: float, classes: DataFrame | None = None) -> DataFrame:
    """a, b (a < b), cosine above `least` of unit vectors (key, term, w) of few terms; with classes (key, keys) a vector stands for all
    its `keys`, and pairs are those of keys, also within a class.

    Prefixes and groups are those of cosine_pairs, but prefix rows take their vectors along, and the join computes the cosine. A pair
    is given by the first term that both hold, and by no other, so neither candidates nor pairs are shuffled: what is, are prefix rows,
    once for each group of their term. Pairs of copies are made last."""
    frequency = settled(weighted.groupBy("term").agg(F.count("*").alias("df")).withColumn("place", F.monotonically_increasing_id()))  # a row a term
    rest = F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(key).orderBy("df", "place").rowsBetween(0, Window.unboundedFollowing))
    placed = F.array_sort(F.collect_list(F.struct("df", "place", "w", "rest")))
    vectors = weighted.join(frequency, "term").withColumn("rest", rest).groupBy(key).agg(placed.alias("v"))
    held = vectors.withColumn("keys", F.array(key)) if classes is None else vectors.join(classes, key)
    chunks = F.transform(F.sequence(F.lit(0), F.ceil(F.size("keys") / COPIES).cast("int") - 1), lambda i: F.slice("keys", i * COPIES + 1, COPIES))
    held = held.where(F.size("keys") > 0).select("v", F.explode(chunks).alias("keys"))
    open_ = F.size(F.filter("v", lambda t: t["rest"] >= (1 - 1e-9) * least * least))
    rows = held.select("keys", F.col("v.place").alias("places"), F.col("v.w").alias("w"), F.col("v.rest").alias("rest"), F.explode(F.sequence(F.lit(0), open_ - 1)).alias("at"))
    at, behind = F.col("at"), F.size("places") - F.col("at") - 1
    own = F.get("w", at)
    prefix = rows.select(F.get("places", at).alias("place"), "keys", own.alias("w"), F.sqrt(F.greatest(F.lit(0.0), F.get("rest", at) - own * own)).alias("after"), F.slice("places", 1, at).alias("before"), F.slice("places", at + 2, behind).alias("places"), F.slice("w", at + 2, behind).alias("ws"))
    groups = prefix.groupBy("place").agg(F.ceil(F.count("*") / PREFIX_ROWS).cast("int").alias("groups"))
    dealt = prefix.join(groups, "place")
    named = lambda rows, group, side: rows.select("place", group.alias("group"), *[F.col(c).alias(f"{c}_{side}") for c in prefix.columns if c != "place"])
    a = named(dealt, F.pmod(F.xxhash64("keys"), "groups").cast("int"), "a")
    b = named(dealt, F.explode(F.sequence(F.lit(0), F.col("groups") - 1)), "b")
    ka, kb = F.get("keys_a", F.lit(0)), F.get("keys_b", F.lit(0))
    within = (ka == kb) & (F.size("before_a") == 0) & (F.size("keys_a") > 1)
    enough = F.col("w_a") * F.col("w_b") + F.col("after_a") * F.col("after_b") >= least - 1e-9
    met = a.join(b, ["place", "group"]).where(((ka < kb) | within) & enough & ~F.arrays_overlap("before_a", "before_b"))
    weight_b = lambda place: F.get("ws_b", F.array_position("places_b", place).cast("int") - 1)
    cosine = F.aggregate(F.zip_with("places_a", "ws_a", lambda place, w: w * F.coalesce(weight_b(place), F.lit(0.0))), F.col("w_a") * F.col("w_b"), lambda s, x: s + x)
    near = met.select("keys_a", "keys_b", F.explode(F.filter(F.array(cosine), lambda c: c > least)).alias("cosine"))  # computed once
    left = near.select(F.explode("keys_a").alias("x"), (ka == kb).alias("same"), "keys_b", "cosine")
    pairs = left.select("x", F.explode("keys_b").alias("y"), "same", "cosine").where(~F.col("same") | (F.col("x") < F.col("y")))
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "cosine")


def long_pairs(weighted: DataFrame, key: str, least: float) -> DataFrame:
    """a, b (a < b), cosine above `least` (which is not negative) of unit vectors (key, at, w) over a vocabulary of bounded size, where most vectors
    share terms and a good part of all pairs is near: what candidates would save, they would cost several times over. key is a long.

    Vectors are dealt to blocks of LONG_BLOCK at most, about; two blocks are one unit of work, a task's, in which strips of rows are multiplied
    as matrices over the terms that both blocks hold. A vector is shuffled once for each block, a pair is never. All pairs are compared:
    work grows with the square of the vectors, memory does not grow."""
    held = settled(weighted.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("at", "w")).alias("v")).select("key", F.col("v.at").alias("at"), F.col("v.w").alias("w")))
    n = held.count()
    number = max(-(-n // LONG_BLOCK), min(LEAST_BLOCKS, n), 1)
    own, other = F.pmod(F.xxhash64("key"), F.lit(number)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    met = held.withColumn("own", own).withColumn("other", other)
    units = met.select(F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), (F.col("own") > F.col("other")).alias("second"), "key", "at", "w")

    def matrix(parts: list[tuple], places: np.ndarray) -> np.ndarray:
        made, first = np.zeros((sum(len(keys) for keys, *_ in parts), len(places))), 0
        for keys, sizes, at, w in parts:
            place = np.minimum(np.searchsorted(places, at), max(len(places) - 1, 0))
            found = places[place] == at if len(places) else np.zeros(len(at), bool)
            made[np.repeat(np.arange(first, first + len(keys)), sizes)[found], place[found]] = w[found]
            first += len(keys)
        return made

    def pairs(unit: tuple[int, int], sides: tuple[list, list]) -> Iterator[pa.RecordBatch]:
        same = unit[0] == unit[1]
        first, second = sides[0], sides[0] if same else sides[1]
        if not first or not second:
            return
        ids = np.concatenate([keys for keys, *_ in second])
        used = [np.unique(np.concatenate([at for _, _, at, _ in side])) for side in (first, second)]
        places = np.intersect1d(*used, assume_unique=True)
        right = matrix(second, places)
        for keys, sizes, at, w in first:
            ends = np.concatenate([[0], np.cumsum(sizes)])
            for start in range(0, len(keys), STRIP):
                end = min(start + STRIP, len(keys))
                cells = slice(ends[start], ends[end])
                cosine = matrix([(keys[start:end], sizes[start:end], at[cells], w[cells])], places) @ right.T
                x, y = np.nonzero(cosine > least)
                a, b = keys[start:end][x], ids[y]
                c = cosine[x, y]
                if same:
                    once = a < b
                    a, b, c = a[once], b[once], c[once]
                yield pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], names=["a", "b", "cosine"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, sides = None, ([], [])
        for batch in batches:
            low, high, second = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            change = np.flatnonzero((low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (second[1:] != second[:-1])) + 1
            for start, end in zip([0, *change.tolist()], [*change.tolist(), len(batch)], strict=True):
                if start == end:
                    continue
                now = (int(low[start]), int(high[start]))
                if unit is not None and now != unit:
                    yield from pairs(unit, sides)
                    sides = ([], [])
                unit, part = now, batch.slice(start, end - start)
                column = lambda i, part=part: part.column(i).flatten().to_numpy(zero_copy_only=False)
                sides[int(second[start])].append((part.column(3).to_numpy(), pc.list_value_length(part.column(4)).to_numpy(), column(4), column(5)))
        if unit is not None:
            yield from pairs(unit, sides)

    dealt = units.repartition(min(number * (number + 1) // 2, 10_000), "low", "high").sortWithinPartitions("low", "high", "second")
    return dealt.mapInArrow(compare, "a long, b long, cosine double")


def dense_pairs(vectors: DataFrame, least: float, cells: int = CELLS, block: int = BLOCK) -> DataFrame:
    """a, b (a < b), cosine above `least` of dense vectors (vec_id, embedding); null, empty and zero
    vectors have none, and all have one length.

    Vectors are dealt to the cell of their nearest pivot, cells to blocks of about `block` vectors. Two blocks are one
    unit of work, compared as matrices, unless the pivots' angle and the cells' radii rule out that any two of their
    vectors are near: angles obey the triangle inequality, so no pair is lost. Only pivots and a figure a cell come
    to the driver; a task holds two blocks, and emits near pairs only."""
    spark = vectors.sparkSession
    held = vectors.where("vec_id is not null and size(embedding) > 0").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = held.withColumn("n", length).where("n > 0").select("vec_id", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    pivots = np.array([r["v"] for r in unit.orderBy(F.xxhash64("vec_id"), "vec_id").limit(cells).collect()])  # `cells` rows at most
    if not len(pivots):
        return spark.createDataFrame([], "a long, b long, cosine double")

    def matrix(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), pivots.shape[1])

    def deal(batches):
        for batch in batches:
            cosines = matrix(batch.column(1)) @ pivots.T
            cell = cosines.argmax(axis=1).astype(np.int32)
            angle = np.arccos(np.clip(cosines[np.arange(len(cell)), cell], -1, 1))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(cell), pa.array(angle)], names=["vec_id", "v", "cell", "angle"])

    dealt = unit.mapInArrow(deal, "vec_id long, v array<double>, cell int, angle double")
    figures = {r["cell"]: (r["n"], r["radius"]) for r in dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}  # a row a cell
    apart = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    reach, blocks = float(np.arccos(least)), {c: -(-n // block) for c, (n, _) in figures.items()}
    met = {(i, j) for i in figures for j in figures if i <= j and apart[i, j] <= figures[i][1] + figures[j][1] + reach + 1e-6}
    partners = spark.createDataFrame([(i, blocks[i], j, blocks[j]) for i, j in sorted(met | {(j, i) for i, j in met})], "cell int, own_blocks int, other int, other_blocks int")
    own = F.struct("cell", F.pmod(F.xxhash64("vec_id"), "own_blocks").cast("int").alias("block")).alias("own")
    there = dealt.join(F.broadcast(partners), "cell").select("vec_id", "v", own, "other", F.explode(F.sequence(F.lit(0), F.col("other_blocks") - 1)).alias("block"))
    there = there.withColumn("there", F.struct(F.col("other").alias("cell"), "block"))
    units = there.select(F.least("own", "there").alias("low"), F.greatest("own", "there").alias("high"), F.when(F.col("own") == F.col("there"), 2).when(F.col("own") < F.col("there"), 0).otherwise(1).alias("side"), "vec_id", "v")
    units = units.select(F.xxhash64("low", "high").alias("unit"), F.col("low.cell").alias("i"), F.col("low.block").alias("s"), F.col("high.cell").alias("j"), F.col("high.block").alias("t"), "side", "vec_id", "v")

    def pairs(ids: np.ndarray, sides: np.ndarray, v: np.ndarray):
        left, right = (np.flatnonzero(sides != 1), np.flatnonzero(sides != 0))
        cosine = v[left] @ v[right].T
        x, y = np.nonzero(cosine > least)
        a, b, c = ids[left[x]], ids[right[y]], cosine[x, y]
        keep = a < b if (sides == 2).all() else a != b
        a, b, c = a[keep], b[keep], c[keep]
        return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(c)], names=["a", "b", "cosine"])

    def compare(batches):
        key, parts = None, []
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(1, 5)], axis=1)
            ids, sides, v = batch.column(6).to_numpy(zero_copy_only=False), batch.column(5).to_numpy(zero_copy_only=False), matrix(batch.column(7))
            starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])) if len(keys) else np.array([], np.int64)
            for start, end in zip(starts.tolist(), [*starts[1:].tolist(), len(keys)], strict=True):
                now = tuple(keys[start].tolist())
                if key is not None and now != key:
                    yield pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                    parts = []
                key = now
                parts.append((ids[start:end], sides[start:end], v[start:end]))
        if parts:
            yield pairs(*(np.concatenate(x) for x in zip(*parts, strict=True)))

    return units.repartition("unit").sortWithinPartitions("unit", "i", "s", "j", "t").mapInArrow(compare, "a long, b long, cosine double")
