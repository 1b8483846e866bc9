"""N-gram Jaccard self-join with adaptive multi-match prefixes.

A document's tokens are its k-word shingles, in one global order from rare to frequent. With a set of s
tokens and ``need = ceil(s * num / den)``, a partner shares at least ``need`` tokens, so the first
``s - need + l`` tokens of both hold at least l common ones. Each document picks its own l from 1 to
``max_level`` by the estimated cost of scanning its prefix and of verifying what the scan would bring; a pair
is verified only if it shares min(l, l') prefix tokens.

Counts come in two steps, both exact. First a fixed share of the token space (twice the share of a prefix)
is counted over all documents; where the tokens that nobody else has fill the prefix already, the document
has no partner and goes. The others are counted over all their tokens. Tokens of buckets that a 32nd of all
documents hit come last in the order and aren't counted, so that no list of the counting grows beyond that.

Only the connected components are asked for, so pairs whose documents are already in one component are not
verified again: rounds that pair every document with one pivot of its token lists merge most groups, then
every pair that is still between two components and passes the filters is verified. Loose members of a group
of near copies are not held against all others either. For a pivot P, let a = |P - x| and b = |x - P|. Two
documents x and y link only if they share (den * (a_x + a_y) + num * (b_x + b_y) - (den - num) * |P|) /
(den + num) of the tokens in which they differ from P. If x doesn't link with P and b_y >= a_y, this exceeds
a_y, so x and y share a token that P hasn't. Pairs of one pivot are therefore looked for by such tokens only.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskwright.llm.common import buckets, by_bucket, cut, deal, dealt_schema, likely, mix, n_buckets, parts, shingle_sets
from maskwright.llm.components import components

#: Buckets of the statistic of frequent tokens, as bits; it has this size whatever the corpus.
BITS = 18
#: A bucket is frequent from this share of all documents on (one in HOT).
HOT = 32
#: Cost of verifying one candidate, in units of one list entry scanned.
VERIFY_COST = 50.0


def _identity(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([mix(s).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)


def _lists(sets: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int32)
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.view(np.int64)))


def _profile(k: int):
    """Per document: size and 128-bit identity of its shingle set; at the end, buckets with many documents."""

    def run(batches):
        seen, rows = np.zeros(1 << BITS, dtype=np.int64), 0
        names = ["doc_id", "n", "s1", "s2", "bucket", "seen"]
        for batch in batches:
            ids = batch.column(0)
            for a, b, texts in parts(batch.column(1)):
                sets = shingle_sets(texts, k)
                seen += np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)
                rows += b - a
                two = _identity([s ^ np.uint64(0xA5A5A5A5A5A5A5A5) for s in sets])
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array([len(s) for s in sets], pa.int64()), pa.array(_identity(sets)), pa.array(two), pa.nulls(b - a, pa.int32()), pa.nulls(b - a, pa.int64())], names)
        hit = np.flatnonzero((seen >= 8) & (seen * 2 * HOT >= rows))
        none = pa.nulls(len(hit), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(hit.astype(np.int32)), pa.array(seen[hit])], names)

    return run


def _counted_share(k: int, num: int, den: int, hot, n: int):
    """The tokens of the counted share with their set's key, dealt by token; each set once a partition."""
    share = np.uint64(min(1 << 16, (1 << 16) * 2 * (den - num) // den))

    def run(batches):
        done = set()
        for batch in batches:
            for _, _, texts in parts(batch.column(0)):
                sets = shingle_sets(texts, k)
                tokens, keys = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
                for key, s in zip(_identity(sets).tolist(), sets):
                    if len(s) and key not in done:
                        done.add(key)
                        tokens.append(s[((s & np.uint64(0xFFFF)) < share) & ~hot.value[(s >> np.uint64(64 - BITS)).astype(np.int64)]])
                        keys.append(np.full(len(tokens[-1]), key, dtype=np.int64).view(np.uint64))
                tok = np.concatenate(tokens)
                yield deal(_bucket(tok, n), tok, np.concatenate(keys))

    return run


def _bucket(x: np.ndarray, n: int) -> np.ndarray:
    return ((x >> np.uint64(17)) % np.uint64(n)).astype(np.int64)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where the runs of equal values of a sorted array begin."""
    new = np.ones(len(x), dtype=bool)
    new[1:] = x[1:] != x[:-1]
    return np.flatnonzero(new)


def _alone(n: int):
    """From tokens with keys to the numbers of tokens that each key has alone, dealt by key."""

    def run(batches):
        for _, (tok, key) in buckets(batches, 2):
            order = np.argsort(tok)
            tok, key = tok[order], key[order]
            at = _runs(tok)
            low = np.minimum.reduceat(key, at)
            own, count = np.unique(low[low == np.maximum.reduceat(key, at)], return_counts=True)
            yield deal(_bucket(mix(own), n), own, count.astype(np.uint64))

    return run


def _totals(batches):
    for _, (key, count) in buckets(batches, 2):
        own, at = np.unique(key, return_inverse=True)
        yield pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(np.bincount(at, count.astype(np.float64)).astype(np.int64))], ["s1", "alone"])


#: Counts that stand for a token that isn't counted, and below 0 for the size of a set (its token is the document then).
UNCOUNTED = 1 << 30


def _all_tokens(k: int, hot, n: int, counted: bool):
    """Each token with the key of document and set, dealt by token (``counted``); or what needn't be counted, with a count, dealt by key."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy().view(np.uint64)
            for a, b, texts in parts(batch.column(1)):
                sets = shingle_sets(texts, k)
                keys = mix(mix(ids[a:b]) ^ _identity(sets).view(np.uint64))
                size = np.array([len(s) for s in sets], dtype=np.int64)
                tok, key = np.concatenate(sets), np.repeat(keys, size)
                frequent = hot.value[(tok >> np.uint64(64 - BITS)).astype(np.int64)]
                if counted:
                    yield deal(_bucket(tok[~frequent], n), tok[~frequent], key[~frequent])
                    continue
                key, tok = np.concatenate([keys, key[frequent]]), np.concatenate([ids[a:b], tok[frequent]])
                count = np.concatenate([-size, np.full(len(tok) - len(size), UNCOUNTED)])
                yield deal(_bucket(mix(key), n), key, tok, count.view(np.uint64))

    return run


def _shared(n: int):
    """From tokens with keys to the tokens that several keys have, with their number, dealt by key."""

    def run(batches):
        for _, (tok, key) in buckets(batches, 2):
            order = np.argsort(tok)
            tok, key = tok[order], key[order]
            at = _runs(tok)
            count = np.diff(np.append(at, len(tok)))
            shared = np.repeat(np.minimum.reduceat(key, at) < np.maximum.reduceat(key, at), count)
            count = np.repeat(count, count)[shared].astype(np.uint64)
            yield deal(_bucket(mix(key[shared]), n), key[shared], tok[shared], count)

    return run


def choose_level(extra: np.ndarray, s: int, need: int, max_level: int) -> int:
    """The l of least estimated cost; ``extra``: other documents on each token's list, rare tokens first."""
    total = np.cumsum(extra[: s - need + max_level])
    levels = np.arange(1, min(max_level, need) + 1)
    length = s - need + levels
    at = total[length - 1]
    return int(levels[np.argmin(length + at + VERIFY_COST * at / levels)])


def _prefixes(num: int, den: int, max_level: int):
    """Per document and set that can have a partner: size, level, places of the prefix, tokens shared with others from rare to frequent."""

    def run(batches):
        for _, (key, tok, count) in buckets(batches, 3):
            order = np.lexsort((tok, count.view(np.int64), key))
            key, tok, count = key[order], tok[order], count[order].view(np.int64)
            at = _runs(key)
            docs, sizes, levels, places, lists = [], [], [], [], []
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(key)]):
                # the size comes first; more than once if several texts of the document have this set
                n, first = -int(count[lo]), int(np.searchsorted(count[lo:hi], 0))
                mine, seen = tok[lo + first : hi], count[lo + first : hi]
                if first > 1 and len(mine):
                    mine, seen = mine[_runs(mine)], seen[_runs(mine)]
                if first == 0 or den * len(mine) < num * n:
                    continue
                need, alone = -(-num * n // den), n - len(mine)
                docs.append(int(tok[lo].view(np.int64)))
                sizes.append(n)
                levels.append(choose_level(np.concatenate([np.zeros(alone), seen - 1.0]), n, need, max_level))
                places.append(n - need + levels[-1] - alone)
                lists.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int32()), _lists(lists)], ["doc", "n", "l", "places", "tokens"])

    return run


def _verify(k: int):
    """Rows (a, b, text_a, text_b), those of one b together: set sizes and overlap of each pair."""

    def run(batches):
        last, kept = None, None
        for batch in batches:
            a, b = (batch.column(i).to_pylist() for i in range(2))
            na, nb, both = [], [], []
            for lo, hi, ta in parts(batch.column(2)):
                left = shingle_sets(ta, k)
                for i in range(lo, hi):
                    tb = batch.column(3)[i].as_py()
                    if last is None or last != (b[i], tb):
                        last, kept = (b[i], tb), shingle_sets([tb], k)[0]
                    x = left[i - lo]
                    at = np.searchsorted(kept, x)
                    na.append(len(x))
                    nb.append(len(kept))
                    both.append(int((kept[np.minimum(at, len(kept) - 1)] == x).sum()) if len(kept) else 0)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(na, pa.int64()), pa.array(nb, pa.int64()), pa.array(both, pa.int64())], ["a", "b", "na", "nb", "o"])

    return run


def _only(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``source`` whose doc_id is in ``wanted``; a filter of fixed size keeps most others from the shuffle."""
    return likely(source, wanted, "doc_id").join(wanted.hint("merge"), "doc_id", "left_semi")


def _no_labels(spark) -> DataFrame:
    return spark.range(0).select(F.col("id").alias("node"), F.col("id").alias("root"))


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, max_level: int = 4, max_rounds: int = 4) -> DataFrame:
    """One row per row of ``docs`` (doc_id long, text string): doc_id, n_shingles, component_id.

    Words are [^\\x20\\x09-\\x0D]+ with A-Z lower-cased. Two documents link when den * |A and B| >= num * |A or B|
    on their sets of k-word shingles; fewer than k words make one shingle. component_id is the smallest
    doc_id reachable over links. Null or empty texts have no shingle and link with nothing (component_id is
    their own doc_id). Rows that share a doc_id count as one document with all their links, each row is
    returned; a null doc_id gets a null component. Other columns of ``docs`` are ignored. An empty table gives
    an empty result. Sets are compared by 64-bit shingle hashes, equal sets by 128 bits.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = cut(source.mapInArrow(_profile(k), "doc_id long, n long, s1 long, s2 long, bucket int, seen long"))
    rows = profile.filter("bucket is null").select("doc_id", "n", "s1", "s2")
    # a document hits as many buckets as it has tokens at most, so this list is bounded by HOT mean documents
    often = profile.filter("bucket is not null").groupBy("bucket").agg(F.sum("seen").alias("seen")).filter(F.col("seen") * HOT >= F.lit(rows.count())).select("bucket").toArrow()
    frequent = np.zeros(1 << BITS, dtype=bool)
    frequent[often.column("bucket").to_numpy()] = True
    hot = spark.sparkContext.broadcast(frequent)

    sets = cut(rows.filter("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("rep")).filter("rep is not null"))
    total = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n = n_buckets(2 * total * (den - num) // den)
    some = by_bucket(source.select("text").mapInArrow(_counted_share(k, num, den, hot, n), dealt_schema(2)))
    alone = by_bucket(some.mapInArrow(_alone(n), dealt_schema(2))).mapInArrow(_totals, "s1 long, alone long")
    # with a whole prefix of its own, a set has no partner
    may = sets.join(alone, "s1", "left").filter(f"coalesce(alone, 0) < n - ({num} * n + {den} - 1) div {den} + 1")
    wanted = cut(may.select(F.col("rep").alias("doc_id"), "n"))
    total = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    texts = cut(_only(source, wanted.select("doc_id").distinct()).distinct())

    n = n_buckets(total)
    counted = by_bucket(texts.mapInArrow(_all_tokens(k, hot, n, True), dealt_schema(2))).mapInArrow(_shared(n), dealt_schema(3))
    others = texts.mapInArrow(_all_tokens(k, hot, n, False), dealt_schema(3))
    chosen = by_bucket(counted.union(others)).mapInArrow(_prefixes(num, den, max_level), "doc long, n long, l int, places int, tokens array<long>")
    # every token shared with others, with its place; m bounds the overlap with anyone
    full = cut(chosen.select("doc", "n", F.size("tokens").cast("long").alias("m"), "l", "places", F.posexplode("tokens").alias("at", "tok")).withColumn("pre", F.expr("at < places")).drop("places"))
    near = F.expr(f"{num} * greatest(n, pn) <= {den} * least(n, pn) and {num + den} * least(m, pm) >= {num} * (n + pn)")
    apart = F.expr("label <> plabel and (star is null or pstar is null or star <> pstar)")
    linking = f"{den} * o >= {num} * (na + nb - o)"

    def compared(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) with sizes and overlap; each text of b is read once for all its partners."""
        one = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a")
        two = one.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b").sortWithinPartitions("b")
        return cut(two.select("a", "b", "ta", "tb").mapInArrow(_verify(k), "a long, b long, na long, nb long, o long"))

    entries = full.filter("pre").withColumn("star", F.lit(None).cast("long"))
    links = labels = None
    for turn in range(max_rounds + 1):
        named = entries.withColumn("label", F.col("doc"))
        if labels is not None:
            named = entries.join(labels.select(F.col("node").alias("doc"), "root"), "doc", "left").withColumn("label", F.coalesce("root", "doc")).drop("root")
        own = F.coalesce("star", -1 - F.col("doc"))
        mixed = named.groupBy("tok").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.min(own).alias("v"), F.max(own).alias("w"), F.count("*").alias("many")).filter("x < y and v < w")
        open_ = cut(named.join(mixed.select("tok", "many"), "tok"))
        size = open_.agg(F.count("*"), F.sum("many")).first()
        if not size[0]:
            break
        last = turn == max_rounds or (turn > 0 and (size[1] <= 8 * size[0] or not found))
        order = F.struct((F.col("n") - F.col("m")).alias("u"), (F.col("doc") if last or turn == 0 else F.xxhash64(F.lit(turn), "doc")).alias("o"))
        pivot = open_.groupBy("tok").agg(F.min(F.struct(order.alias("o"), F.col("doc").alias("b"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("label").alias("plabel"), F.col("star").alias("pstar"))).alias("p")).select("tok", "p.b", "p.pn", "p.pm", "p.plabel", "p.pstar")
        if last:
            # no pair is left among those of a list that share the pivot's star, or else its component
            side = open_.join(pivot.select("tok", "plabel", "pstar"), "tok").withColumn("inner", F.coalesce(F.expr("star = pstar"), F.expr("pstar is null and label = plabel"))).drop("plabel", "pstar")
            side = cut(side.select("tok", "doc", "n", "m", "l", "at", "pre", "label", "star", "inner"))
            other = side.select("tok", F.col("doc").alias("b"), F.col("n").alias("pn"), F.col("m").alias("pm"), F.col("l").alias("pl"), F.col("at").alias("pat"), F.col("pre").alias("ppre"), F.col("label").alias("plabel"), F.col("star").alias("pstar"), F.col("inner").alias("pinner"))
            met = side.filter("not inner").join(other, "tok").filter("pinner or doc < b").filter(near).filter(apart)
            pairs = met.groupBy(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b")).agg(F.count(F.expr("case when pre and ppre then 1 end")).alias("c"), F.count("*").alias("any"), F.min(F.least("l", "pl")).alias("least"))
            # a pair of two levels shares min(l, l') tokens of the prefixes; one of a pivot shares a token that the pivot hasn't
            starred = stars.select(F.col("doc").alias("a"), F.col("star").alias("x")), stars.select(F.col("doc").alias("b"), F.col("star").alias("y"))
            pairs = pairs.join(starred[0], "a", "left").join(starred[1], "b", "left").filter("c >= least or x = y").select("a", "b")
            links = links.union(compared(pairs).filter(linking).select("a", "b"))
            labels = components(links)
            break
        best = open_.join(pivot, "tok").filter(near).filter(apart).groupBy(F.col("doc").alias("a"), "b").agg(F.count("*").alias("c")).groupBy("a").agg(F.max(F.struct("c", (-F.col("b")).alias("o"))).alias("p")).select("a", (-F.col("p.o")).alias("b"))
        tried = compared(best)
        if turn == 0:
            one = tried.groupBy("a", "b").agg(F.count("*").alias("rows"), F.max("na").alias("na"), F.max("nb").alias("nb")).filter("rows = 1")
            hubs = one.select(F.col("b").alias("doc")).distinct()
            stars = cut(one.filter("na >= nb").select(F.col("a").alias("doc"), F.col("b").alias("star")).join(hubs, "doc", "left_anti").union(hubs.select("doc", "doc")))
            # a starred document's tokens that its pivot has are told by the star, all others are looked up
            theirs = full.select(F.col("doc").alias("star"), "tok", F.lit(True).alias("has"))
            told = full.join(stars, "doc", "left").join(theirs, ["star", "tok"], "left").filter("pre or (star is not null and has is null)")
            entries = cut(told.withColumn("star", F.expr("if(has, star, null)")).select("tok", "doc", "n", "m", "l", "at", "pre", "star"))
        more = tried.filter(linking).select("a", "b")
        found = not more.isEmpty()
        links = more if links is None else links.union(more)
        labels = components(links) if found else labels if labels is not None else _no_labels(spark)
    if labels is None:
        labels = _no_labels(spark)
    keyed = rows.join(sets, ["s1", "s2", "n"], "left").join(labels.select(F.col("node").alias("rep"), "root"), "rep", "left")
    return keyed.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("root", "rep", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id, then of the smallest hash of its text; rows without doc_id stay.

    Rows that share a doc_id are told apart by their texts: unlike ones are components of their own and all stay, equal
    ones leave one row, the first in the order of its columns as JSON. Columns keep names, types and order whatever they are called.
    """
    own = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    plain = docs.toDF(*own.values())
    doc, text = own["doc_id"], own["text"]
    rows = plain.filter(F.col(doc).isNotNull()).withColumn("key", F.struct(F.col(doc).cast("long").alias("id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(7), text).alias("h2")))
    several = cut(rows.groupBy("key.id").agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("*").alias("rows")).filter("a <> b"))
    # a row of an id with several texts goes by a hash of both; other documents go by their id
    if several.isEmpty():
        rows = rows.withColumn("unit", F.col("key.id"))
        named = None
    else:
        hot = F.broadcast(several.filter(F.col("rows") * 1000 > F.lit(rows.count())).select("id", F.lit(True).alias("many")))
        rest = several.join(hot, "id", "left_anti").select("id", F.lit(True).alias("many"))
        marked = rows.withColumn("id", F.col("key.id"))
        rows = marked.join(hot, "id", "left_semi").withColumn("many", F.lit(True)).unionByName(marked.join(hot, "id", "left_anti").join(rest.hint("merge"), "id", "left"))
        rows = rows.withColumn("unit", F.when(F.col("many"), F.xxhash64("key")).otherwise(F.col("id"))).drop("id", "many")
        named = cut(rows.filter("unit <> key.id").select("unit", "key").distinct())
    found = jaccard_components(rows.select(F.col("unit").alias("doc_id"), F.col(text).alias("text")), **how).select(F.col("doc_id").alias("unit"), "component_id")
    if named is None:
        kept = found.filter("unit = component_id").select("unit").distinct()
    else:
        first = F.min(F.struct(F.coalesce("key", F.struct(F.col("unit").alias("id"), F.lit(None).cast("long").alias("h1"), F.lit(None).cast("long").alias("h2"))).alias("key"), "unit"))
        kept = found.distinct().join(named, "unit", "left").groupBy("component_id").agg(first.alias("first")).select("first.unit").distinct()
    left = rows.join(kept, "unit", "left_semi")
    whole = F.struct(*own.values())
    one = left.groupBy("unit").agg(F.min_by(whole, F.to_json(whole)).alias("row")).select("row.*")
    return one.unionByName(plain.filter(F.col(doc).isNull())).toDF(*docs.columns)
