"""Problem 6: records of the evaluation split that occur, exactly or almost, in the training split."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Written, write_out

#: Words of a seed, words of a shared span, and rows of one side that a task compares at once.
SEED, SPAN, BLOCK = 3, 5, 4_000


def plain_words(text: Column) -> Column:
    """The words of a text in lower case; spacing and punctuation don't count. Null gives null."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shared(longer: int, percent: int) -> int:
    """Seeds that two texts share at least, if ``percent`` of the ``longer`` text's words stand in the other in order.

    At most d words are missing and, as the other text isn't longer, at most d are added; a missing word breaks three
    seeds, an added one two.
    """
    d = longer * (100 - percent) // 100
    return longer - SEED + 1 - 5 * d


def _needed(n: int, percent: int) -> int:
    """The least of ``_shared`` over all lengths that a partner of a text of ``n`` words can have."""
    return min(_shared(m, percent) for m in range(n, n * 100 // percent + 1))


def _seeds(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mix, many = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
        for b in batches:
            seeds, tids, places, sides, slack = [], [], [], [], []
            for tid, h, ev, tr in zip(b["tid"], b["h"], b["ev"], b["tr"]):
                h = np.asarray(h, dtype=np.int64).view(np.uint64)
                n, own = len(h), []
                with np.errstate(over="ignore"):
                    if n >= SEED:
                        g = np.zeros(n - SEED + 1, dtype=np.uint64)
                        for i in range(SEED):
                            g = (g ^ h[i : n - SEED + 1 + i]) * mix + many
                        # The second place of a seed in a text is another seed, so that shared places can be counted.
                        order = np.argsort(g, kind="stable")
                        first = np.r_[0, np.flatnonzero(np.diff(g[order])) + 1]
                        again = np.empty(len(g), dtype=np.uint64)
                        again[order] = (np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))).astype(np.uint64)
                        own.append((g ^ (again * mix), np.arange(len(g)), 1 - max(1, _needed(n, percent))))
                    # Texts so short that an allowed change can break every seed: keys with a word or more left out.
                    short = [m for m in range(n, n * 100 // percent + 1) if _shared(m, percent) < 1]
                    if short:
                        left = {(): h}
                        for _ in range(n - min(-(-m * percent // 100) for m in short)):
                            left |= {(*w, i): np.delete(x, i) for w, x in left.items() for i in range(len(x))}
                        keys = []
                        for x in left.values():
                            k = np.uint64(len(x))
                            for w in x:
                                k = (k ^ w) * mix + many
                            keys.append(k)
                        keys = np.unique(np.array(keys, dtype=np.uint64))
                        own.append((keys, np.full(len(keys), -1), 0))
                for g, p, k in own:
                    seeds.append(g.view(np.int64))
                    places.append(p)
                    tids.append(np.full(len(g), tid))
                    sides.append(np.full(len(g), int(ev) + 2 * int(tr)))
                    slack.append(np.full(len(g), k))
            if seeds:
                yield pd.DataFrame({"seed": np.concatenate(seeds), "tid": np.concatenate(tids), "pos": np.concatenate(places), "side": np.concatenate(sides), "slack": np.concatenate(slack)})

    return run


def _meet(percent: int):
    """Walk a sorted part of the suffix array: within an interval of suffixes with equal beginnings, evaluation and training texts."""

    def compare(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        side, tid, n, cell = (rows[c].to_numpy() for c in ("side", "tid", "n", "cell"))
        starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        ends = np.r_[starts[1:], len(rows)]
        train = np.add.reduceat(side, starts)
        mixed = np.flatnonzero((train > 0) & (train < ends - starts))

        def pairs(e: np.ndarray, t: np.ndarray) -> pd.DataFrame:
            ok = (100 * np.minimum(n[e], n[t]) >= percent * np.maximum(n[e], n[t])) & (tid[e] != tid[t])
            return pd.DataFrame({"a": tid[e[ok]], "b": tid[t[ok]]}).drop_duplicates()

        held, count = [], 0
        for a, b in zip(starts[mixed], ends[mixed]):
            e, t = a + np.flatnonzero(side[a:b] == 0), a + np.flatnonzero(side[a:b] == 1)
            # Only training texts of a fitting length meet an evaluation text: they stand together once sorted by length.
            t = t[np.argsort(n[t], kind="stable")]
            low, high = np.searchsorted(n[t], -(-n[e] * percent // 100), "left"), np.searchsorted(n[t], n[e] * 100 // percent, "right")
            for x, i, j in zip(e, low, high):
                held.append((np.full(j - i, x), t[i:j]))
                count += j - i
                if count > 500_000:
                    yield pairs(*map(np.concatenate, zip(*held)))
                    held, count = [], 0
        if held:
            yield pairs(*map(np.concatenate, zip(*held)))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for b in batches:
            rest = b if rest is None else pd.concat([rest, b], ignore_index=True)
            if len(rest):
                last = rest["cell"].to_numpy() == rest["cell"].iloc[-1]
                cut = len(rest) - int(last.sum())
                if cut:
                    yield from compare(rest.iloc[:cut])
                rest = rest.iloc[cut:].reset_index(drop=True)
        if rest is not None and len(rest):
            yield from compare(rest)

    return walk


def common_words(a: list, b: list) -> int:
    """Length of the longest common subsequence, bit-parallel over ``b``."""
    where: dict = {}
    for i, w in enumerate(b):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(b)) - 1
    v = full
    for w in a:
        u = v & where.get(w, 0)
        v = ((v + u) | (v - u)) & full
    return len(b) - v.bit_count()


def _verify(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            common = [common_words(x.split(" "), y.split(" ")) for x, y in zip(b["ta"], b["tb"])]
            b = b.assign(common=common)
            yield b.loc[100 * b["common"] >= percent * np.maximum(b["na"], b["nb"]), ["a", "b", "common"]]

    return run


def near_texts(texts: DataFrame, percent: int = 85) -> DataFrame:
    """(a, b, common) of different texts, a in evaluation and b in training, that are almost the same.

    ``texts``: (tid: long, words: array<string>, ev, tr: boolean), each text once. Almost the same: ``percent`` of the
    words of the longer text stand in the other in the same order; ``common`` counts them.

    Method: the suffixes of all texts are partitioned by their first three words, so that a partition's intervals of equal
    beginnings are those of the suffix array. Intervals with suffixes of both splits cover a text; alike texts share a
    known number s of such seeds, so that texts with fewer seeds shared with the other split drop out, and for the others
    all but the s - 1 costliest intervals (by the product of the splits' counts) are enough to meet every partner: no pair
    is lost. Intervals that stay long are compared in blocks, both sides dealt to many tasks. What remains is checked
    exactly by the longest common subsequence.
    """
    nodes = texts.where(F.size("words") > 0).select("tid", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").alias("n"), "ev", "tr")
    seeds = Written(nodes.select("tid", "h", "ev", "tr").mapInPandas(_seeds(percent), "seed long, tid long, pos int, side tinyint, slack int"), "seeds")
    rows = seeds.df
    cost = rows.groupBy("seed").agg(F.count_if(F.col("side") != 2).alias("e"), F.count_if(F.col("side") != 1).alias("t")).where("e > 0 and t > 0")
    # Seeds of one split only cost nothing and come first; they are not carried along, the rest is counted from the end.
    mine = Window.partitionBy("tid", F.col("pos") < 0)
    place = F.row_number().over(mine.orderBy(F.col("e") * F.col("t"), "seed")) - F.count("*").over(mine)
    chosen = rows.join(cost, "seed").withColumn("_r", place).where(F.col("_r") <= F.col("slack"))
    chosen = chosen.select("seed", "tid", "side", "e", "t").join(nodes.select("tid", "n"), "tid")
    deal_e, deal_t = F.ceil(F.col("e") / BLOCK).cast("int"), F.ceil(F.col("t") / BLOCK).cast("int")
    mine = lambda deal: F.pmod(F.xxhash64("tid"), deal)
    part = lambda flag, s, x, y: chosen.where(flag).select("tid", "n", F.lit(s).alias("side"), "seed", x, y)
    every = lambda deal: F.explode(F.sequence(F.lit(0), deal - 1))
    ev = part("side <> 2", 0, mine(deal_e).alias("x"), every(deal_t).alias("y"))
    tr = part("side <> 1", 1, every(deal_e).alias("x"), mine(deal_t).alias("y"))
    suffixes = ev.union(tr).select("tid", "n", "side", F.when((F.col("x") == 0) & (F.col("y") == 0), F.col("seed")).otherwise(F.xxhash64("seed", "x", "y")).alias("cell"))
    pairs = suffixes.repartition("cell").sortWithinPartitions("cell").mapInPandas(_meet(percent), "a long, b long").distinct()
    text = texts.select("tid", F.array_join("words", " ").alias("text"), F.size("words").alias("n"))
    full = pairs.join(text.select(F.col("tid").alias("a"), F.col("text").alias("ta"), F.col("n").alias("na")), "a").join(
        text.select(F.col("tid").alias("b"), F.col("text").alias("tb"), F.col("n").alias("nb")), "b"
    )
    done = write_out(full.select("a", "b", "ta", "na", "tb", "nb").mapInPandas(_verify(percent), "a long, b long, common int"), "near")
    seeds.drop()
    return done


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    mix, many = np.uint64(0x9E3779B97F4A7C15), np.uint64(31)
    for b in batches:
        out = []
        for tid, h, ev in zip(b["tid"], b["h"], b["ev"]):
            h = np.asarray(h, dtype=np.int64).view(np.uint64)
            g = np.zeros(len(h) - SPAN + 1, dtype=np.uint64)
            with np.errstate(over="ignore"):
                for i in range(SPAN):
                    g = (g ^ h[i : len(h) - SPAN + 1 + i]) * mix + many
            out.append((g.view(np.int64), np.full(len(g), tid), np.arange(len(g)), np.full(len(g), bool(ev))))
        if out:
            yield pd.DataFrame(dict(zip(("gram", "tid", "pos", "ev"), map(np.concatenate, zip(*out)))))


def coverage(texts: DataFrame) -> DataFrame:
    """(tid, n, covered): words of every text, and those in spans of ``SPAN`` words or more that it shares with the other split.

    ``texts`` as in ``near_texts``. A text of both splits is covered as a whole; a shorter one than a span otherwise not at
    all. Suffixes that begin with the same ``SPAN`` words are neighbours in the suffix array; where an interval has both
    splits, each of its suffixes begins a shared span, and overlapping spans are merged, to any length.
    """
    both = texts.select("tid", F.size("words").alias("n"), (F.col("ev") & F.col("tr")).alias("both"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"), "ev")
    # A text of both splits gives its suffixes to either.
    sides = both.where(f"n >= {SPAN}").select("tid", "h", F.explode(F.when(F.col("both"), F.array(F.lit(True), F.lit(False))).otherwise(F.array("ev"))).alias("ev"))
    grams = Written(sides.mapInPandas(_grams, "gram long, tid long, pos int, ev boolean"), "grams")
    mixed = grams.df.groupBy("gram").agg(F.bool_or("ev").alias("e"), F.bool_or(~F.col("ev")).alias("t")).where("e and t").select("gram")
    starts = grams.df.join(mixed, "gram").groupBy("tid").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    step = F.aggregate("at", F.struct(F.lit(0).alias("to"), F.lit(0).alias("sum")), lambda s, p: F.struct((p + SPAN).alias("to"), (s["sum"] + SPAN - F.greatest(F.lit(0), s["to"] - p)).alias("sum")))
    shared = starts.select("tid", step["sum"].alias("covered"))
    out = both.select("tid", "n", "both").join(shared, "tid", "left").select("tid", "n", F.when(F.col("both"), F.col("n")).otherwise(F.coalesce("covered", F.lit(0))).alias("covered"))
    out = write_out(out, "covered")
    grams.drop()
    return out


def classes(df: DataFrame, key: str, evaluation: str, hashes: list[str], text: Column) -> tuple[DataFrame, DataFrame]:
    """Records (key, ev, h0.., tid) and their different texts (tid, words, ev, tr); blank hashes and texts without words are null.

    Rows without key or split take no part, repeated rows count once; each text is kept once.
    """
    blank = lambda c: F.when(F.trim(F.coalesce(F.col(c), F.lit(""))) != "", F.col(c))
    rows = df.where(F.col(key).isNotNull() & F.col(evaluation).isNotNull())
    worded = rows.select(F.col(key).alias("key"), F.col(evaluation).alias("ev"), *[blank(h).alias(f"h{i}") for i, h in enumerate(hashes)], plain_words(text).alias("words"))
    worded = worded.withColumn("same", F.when(F.size("words") > 0, F.md5(F.array_join("words", " "))))
    # Each text travels once; its records follow by the digest of its words.
    texts = worded.where("same is not null").groupBy("same").agg(F.first("words").alias("words"), F.bool_or("ev").alias("ev"), F.bool_or(~F.col("ev")).alias("tr"))
    texts = write_out(texts.withColumn("tid", F.monotonically_increasing_id()), "texts")
    records = worded.drop("words").distinct().join(texts.select("same", "tid"), "same", "left").drop("same")
    return records, texts


def _links(texts: DataFrame, percent: int) -> DataFrame:
    """(a, b): alike texts of the two splits, a text of both with itself."""
    return near_texts(texts, percent).select("a", "b").union(texts.where("ev and tr").select(F.col("tid").alias("a"), F.col("tid").alias("b")))


def overlaps(df: DataFrame, key: str, evaluation: str, hashes: list[str], text: Column, percent: int = 85) -> DataFrame:
    """(eval_key, train_key) of records, one of each split, with an equal hash or (almost) equal texts; each pair once.

    Rows without key or split take no part, repeated rows count once; null or blank hashes and texts without words match
    nothing. An empty table gives no rows. Copies of a text are compared once and expanded at the end.
    """
    records, texts = classes(df, key, evaluation, hashes, text)
    left = records.where("ev").withColumnRenamed("key", "eval_key")
    right = records.where("not ev").withColumnRenamed("key", "train_key")
    near = _links(texts, percent).join(left.select("eval_key", F.col("tid").alias("a")), "a").join(right.select("train_key", F.col("tid").alias("b")), "b")
    found = near.select("eval_key", "train_key")
    for h in (f"h{i}" for i in range(len(hashes))):
        same = left.select("eval_key", h).distinct().join(right.select("train_key", h).distinct(), h)
        found = found.union(same.select("eval_key", "train_key"))
    return found.distinct()


def link_counts(df: DataFrame, key: str, evaluation: str, hashes: list[str], text: Column, percent: int = 85) -> DataFrame:
    """(key, ev, links): records with partners in the other split and how many, as ``overlaps`` would pair them.

    No pair of records is formed: partners are counted per equal hash and per class of texts, and by inclusion and
    exclusion those that agree in several ways count once. A key is expected in one row.
    """
    records, texts = classes(df, key, evaluation, hashes, text)
    records = write_out(records, "records")
    links = write_out(_links(texts, percent), "links")
    names, out = [f"h{i}" for i in range(len(hashes))], None
    for ev in (True, False):
        own, other = records.where(F.col("ev") == ev), records.where(F.col("ev") != ev)
        # Own text, partner text.
        way = links.select(F.col("a" if ev else "b").alias("tid"), F.col("b" if ev else "a").alias("to"))
        for bits in range(2 ** len(names)):
            on = [h for i, h in enumerate(names) if bits >> i & 1]
            for near in (False, True):
                if not on and not near:
                    continue
                known = other.where(" and ".join(f"{h} is not null" for h in on) if on else "true")
                if near:
                    n = known.where("tid is not null").groupBy(F.col("tid").alias("to"), *on).agg(F.count("*").alias("n"))
                    n = n.join(way, "to").groupBy("tid", *on).agg(F.sum("n").alias("n"))
                else:
                    n = known.groupBy(*on).agg(F.count("*").alias("n"))
                sign = 1 if (len(on) + near) % 2 else -1
                part = own.join(n, [*on, *(["tid"] if near else [])]).select("key", "ev", (sign * F.col("n")).alias("n"))
                out = part if out is None else out.union(part)
    return out.groupBy("key", "ev").agg(F.sum("n").alias("links"))
