"""Problem 4: freely typed values mapped to the entry of a reference list that means the same."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..runtime import bounded_broadcast, write_out

_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")


def _plain(text: str | None) -> str:
    plain = "".join(c for c in unicodedata.normalize("NFKD", text or "") if not unicodedata.combining(c))
    return _CAMEL.sub(" ", plain).lower()


def tokens(text: str | None) -> list[str]:
    """Lower-case words of a value: marks and width folded, camel case split; digits stay with their letters."""
    return re.findall(r"[^\W_]+", _plain(text))


def placed(text: str | None) -> list[tuple[int, str, int, int]]:
    """(place, word, from, to): words of a typed value with their places and characters: letters without the digits beside
    them, numbers, and words with their digits as they stand. A number may belong to the word before or after it, so
    it has the places of both."""
    out, at, plain = [], 0, _plain(text)
    for c in re.finditer(r"[^\W_]+", plain):
        first, runs = at, list(re.finditer(r"[^\W\d_]+|\d+", c[0]))
        for r in runs:
            lo, hi = c.start() + r.start(), c.start() + r.end()
            if r[0][0].isdigit():
                out += [(at - 1, r[0], lo, hi), (at, r[0], lo, hi)]
            else:
                out.append((at, r[0], lo, hi))
                at += 1
        if len(runs) > 1:
            out += [(p, c[0], c.start(), c.end()) for p in sorted({first, max(first, at - 1)})]
    return out


def _exact(word: str) -> bool:
    """Numbers are never repaired: another number means another thing."""
    return any(c.isdigit() for c in word)


def edits(word: Column, apart: Column) -> Column:
    """Edits that a token may be away from a reference ``word``. Three letters allow one only beside other words of a phrase;
    words with digits none."""
    n = F.when(word.rlike(r"\p{N}"), 0).otherwise(F.length(word))
    return F.when(n >= 7, 2).when((n >= 4) | ((n == 3) & ~apart), 1).otherwise(0)


def distance(a: str, b: str) -> int:
    """Edit distance in which swapped letters are one edit, also with letters added between them."""
    last: dict[str, int] = {}
    far = len(a) + len(b)
    d = [[far] * (len(b) + 2) for _ in range(len(a) + 2)]
    for i in range(len(a) + 1):
        d[i + 1][1] = i
    for j in range(len(b) + 1):
        d[1][j + 1] = j
    for i in range(1, len(a) + 1):
        match = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), match
            if a[i - 1] == b[j - 1]:
                match = j
            d[i + 1][j + 1] = min(d[i][j] + (a[i - 1] != b[j - 1]), d[i + 1][j] + 1, d[i][j + 1] + 1, d[k][m] + i - k + j - m - 1)
        last[a[i - 1]] = i
    return d[-1][-1]


def shortened(word: str, most: int) -> set[str]:
    """``word`` with up to ``most`` letters left out."""
    out = now = {word}
    for _ in range(most):
        now = {w[:i] + w[i + 1 :] for w in now for i in range(len(w))}
        out = out | now
    return out


def _variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(k, t, v) for k, t in zip(b["kind"], b["token"]) for v in shortened(t, 0 if len(t) < 3 or _exact(t) else 1 if len(t) < 5 else 2)]
        yield pd.DataFrame(rows, columns=["kind", "token", "variant"])


def _word_variants(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Variants of reference words, and their beginnings (whole or with a letter left out) as abbreviations."""
    for b in batches:
        rows = []
        for k, w, most in zip(b["kind"], b["word"], b["most"]):
            rows += [(k, w, v, most, False) for v in shortened(w, most)]
            heads = set() if _exact(w) else {w[:n] for n in range(4, len(w))}
            heads |= {h[:i] + h[i + 1 :] for h in heads if len(h) > 6 for i in range(3, len(h) - 1)}
            rows += [(k, w, h, most, True) for h in heads]
        yield pd.DataFrame(rows, columns=["kind", "word", "variant", "most", "head"])


def _measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        cost = [
            0.0 if t == w else 0.5 if h else float(distance(t, w)) if abs(len(t) - len(w)) <= 2 else 9.0
            for t, w, h in zip(b["token"], b["word"], b["head"] & (b["token"] == b["variant"]))
        ]
        b = b.assign(cost=cost)
        yield b.loc[(b["cost"] <= 0.5) | (b["cost"] <= b["most"]), ["kind", "token", "word", "cost"]]


def repair(found: DataFrame, words: DataFrame) -> DataFrame:
    """(kind, token, at, word, sim): reference words that each distinct token stands for; ``at`` orders split tokens.

    Joins distinct tokens (kind, token) with reference ``words`` (kind, word, most edits) by edit distance: both sides meet in what
    remains after leaving letters out, which loses no pair within the allowed edits. A known word stands for itself; the
    least distance wins and ties stay. A token that is two known words written together, or with one letter between them, stands for both.
    """
    sides = found.mapInPandas(_variants, "kind string, token string, variant string")
    heads = words.mapInPandas(_word_variants, "kind string, word string, variant string, most int, head boolean")
    pairs = sides.join(bounded_broadcast(heads), ["kind", "variant"]).distinct()
    costs = pairs.select("kind", "token", "word", "variant", "most", "head").mapInPandas(_measure, "kind string, token string, word string, cost double")
    costs = write_out(costs.groupBy("kind", "token", "word").agg(F.min("cost").alias("cost")), "costs")
    least = costs.groupBy("kind", "token").agg(F.min("cost").alias("least"))
    near = costs.join(least, ["kind", "token"]).where("cost = least")
    one = near.select("kind", "token", F.lit(0).alias("at"), "word", (1 - F.col("cost") / F.length("token")).alias("sim"))
    cut = F.explode(F.sequence(F.lit(3), F.length("token") - 3)).alias("c")
    gap = F.explode(F.array(F.lit(1), F.lit(2))).alias("g")
    parts = found.where("length(token) >= 6").select("kind", "token", cut).select("*", gap)
    parts = parts.select("kind", "token", "g", F.expr("left(token, c)").alias("l"), F.expr("substring(token, c + g)").alias("r"))
    known = bounded_broadcast(words.select("kind", "word"))
    both = parts.join(known.withColumnRenamed("word", "l"), ["kind", "l"]).join(known.withColumnRenamed("word", "r"), ["kind", "r"])
    # Written together beats a misspelling; with a letter between the two, it is the last resort.
    both = both.join(least, ["kind", "token"], "left").where("least is null or least > 0 and g = 1")
    tight = both.groupBy("kind", "token").agg(F.min("g").alias("g"))
    both = both.join(tight, ["kind", "token", "g"])
    split = both.select("kind", "token", F.posexplode(F.array("l", "r")).alias("at", "word")).withColumn("sim", F.lit(1.0))
    whole = one.join(split.select("kind", "token").distinct(), ["kind", "token"], "left_anti")
    return whole.union(split).distinct()


def _reference(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Phrases of the entries of a reference list, one row each.

    A label of several words has two parts, its first word (a) and the others (b). A synonym that keeps one of them says the
    other in other words; such words mean the same in every entry. A label of one word and a synonym that keeps neither
    part stand for the whole entry (w).
    """
    for batch in batches:
        rows = []
        for item, kind, label, others in zip(batch["item_id"], batch["kind"], batch["label"], batch["synonyms"]):
            words = tokens(label)
            if not words:
                continue
            a, b = words[0], " ".join(words[1:])
            here = {("a", a, a), ("b", b, b)} if b else {("w", a + "|", a)}
            for other in others if others is not None else []:
                t = " ".join(tokens(other))
                if b and t.endswith(" " + b):
                    here.add(("a", a, t[: -len(b) - 1]))
                elif b and t.startswith(a + " "):
                    here.add(("b", b, t[len(a) + 1 :]))
                elif t:
                    here.add(("w", f"{a}|{b}", t))
            rows += [(item, kind, a, b, *h) for h in sorted(here)]
        yield pd.DataFrame(rows, columns=["item_id", "kind", "a", "b", "part", "meaning", "phrase"])


def _tokenise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for r, k, *texts in zip(b["rid"], b["kind"], b["first"], b["second"]):
            for f, s in enumerate(texts):
                told = placed(s)
                n = 1 + max((t[0] for t in told), default=0)
                rows += [(r, k, f, i, t, lo, hi, n) for i, t, lo, hi in told]
        yield pd.DataFrame(rows, columns=["rid", "kind", "field", "pos", "token", "lo", "hi", "of"])


def _resolve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidate entries of a record with their soft TF-IDF weight: each part from the field that states it best."""
    for b in batches:
        rows = []
        for rid, kind, hits in zip(b["rid"], b["kind"], b["hits"]):
            hits = [h.asDict() if hasattr(h, "asDict") else h for h in hits]
            # The name of a whole entry must be more than half of what its field says.
            hits = [h for h in hits if h["part"] != "w" or 2 * h["size"] > h["of"]]
            # Words inside a longer phrase of the same field don't speak for themselves.
            free = [
                h for h in hits
                if not any(o["field"] == h["field"] and o["size"] > h["size"] and o["low"] <= h["low"] and h["high"] <= o["high"] for o in hits)
            ]
            best: dict[str, dict[str, dict[int, float]]] = {"a": {}, "b": {}, "w": {}}
            for h in free:
                by = best[h["part"]].setdefault(h["meaning"], {})
                by[h["field"]] = max(by.get(h["field"], 0.0), h["weight"])
            for a, wa in best["a"].items():
                for m, wb in best["b"].items():
                    rows.append((rid, kind, a, m, sum(wa.values()) + sum(wb.values())))
            # A whole entry states both parts at once.
            rows += [(rid, kind, *m.split("|"), 2 * sum(w.values())) for m, w in best["w"].items()]
        yield pd.DataFrame(rows, columns=["rid", "kind", "a", "b", "score"])


def canonical(records: DataFrame, items: DataFrame | list[tuple]) -> DataFrame:
    """(kind, first, second, item_id) for distinct ``records`` (kind, first, second: string); 0 where no entry fits.

    ``items``: the reference list (item_id: long, kind, label: string, synonyms: array<string>), a table of any size or a
    short list of tuples; rows without item_id, kind or label have no meaning. Each distinct token is repaired against the reference vocabulary; phrases of
    the list are found in the corrected tokens; entries are ranked by the soft TF-IDF weight of their parts and the best
    pair of meanings decides. Both parts must be stated, by their own words or by a name of the whole entry: a pair of
    meanings without an entry has none, and a pair that ties with another one goes to the listed one, then to the smaller
    item_id. Numbers in words are never repaired. Null and empty texts say nothing; an empty table gives no rows.
    """
    if not isinstance(items, DataFrame):
        items = records.sparkSession.createDataFrame(items, "item_id long, kind string, label string, synonyms array<string>")
    one = write_out(records.distinct().withColumn("rid", F.monotonically_increasing_id()), "records")
    told = one.select("rid", "kind", "first", "second").mapInPandas(_tokenise, "rid long, kind string, field int, pos int, token string, lo int, hi int, of int")
    told = write_out(told, "tokens")
    given = items.where("item_id is not null and kind is not null and label is not null").select("item_id", "kind", "label", "synonyms")
    list_ = write_out(given.mapInPandas(_reference, "item_id long, kind string, a string, b string, part string, meaning string, phrase string"), "list")
    entries = list_.groupBy("kind", "a", "b").agg(F.min("item_id").alias("item_id"))
    total = entries.groupBy("kind").agg(F.count("*").alias("total"))
    of_word = entries.select("kind", F.explode(F.array_distinct(F.split(F.concat_ws(" ", "a", F.when(F.col("b") != "", F.col("b"))), " "))).alias("head"))
    of_word = of_word.groupBy("kind", "head").agg(F.count("*").alias("n"))
    phrases = list_.select("kind", "part", "meaning", "phrase").distinct().withColumn("head", F.regexp_extract("meaning", r"^[^ |]*", 0))
    idf = F.log(1 + F.col("total") / F.greatest(F.coalesce("n", F.lit(1)), F.lit(1)))
    phrases = phrases.join(of_word, ["kind", "head"], "left").join(total, "kind").select("kind", "part", "meaning", "phrase", F.split("phrase", " ").alias("ws"), idf.alias("idf"))
    phrases = phrases.select(F.xxhash64("kind", "part", "meaning", "phrase").alias("p"), "kind", "part", "meaning", F.size("ws").alias("size"), (F.col("idf") / F.size("ws")).alias("idf"), F.posexplode("ws").alias("i", "word"))
    table = write_out(phrases, "phrases")
    # A phrase of one word stands apart: three letters alone are never repaired.
    words = table.groupBy("kind", "word").agg(F.bool_or(F.col("size") == 1).alias("apart"))
    words = write_out(words.select("kind", "word", edits(F.col("word"), F.col("apart")).alias("most")), "words")
    fixed = write_out(repair(told.select("kind", "token").distinct(), words), "repaired")
    # Split tokens take two places, so places count in steps.
    seen = told.join(fixed, ["kind", "token"]).select("rid", "kind", "field", "of", (F.col("pos") * 2 + F.col("at")).alias("place"), "pos", "at", "lo", "hi", "word", "sim")
    spots = seen.join(bounded_broadcast(table), ["kind", "word"])
    start = F.when(F.col("size") == 1, F.col("place")).otherwise(2 * (F.col("pos") + F.col("at") - F.col("i")))
    hits = spots.groupBy("rid", "kind", "field", "of", "p", "part", "meaning", "size", start.alias("start")).agg(F.count_distinct("i").alias("n"), F.sum(F.col("idf") * F.col("sim")).alias("weight"), F.min("lo").alias("low"), F.max("hi").alias("high"))
    hits = hits.where("n = size").groupBy("rid", "kind").agg(
        F.collect_list(F.struct("field", "of", "part", "meaning", "size", "low", "high", "weight")).alias("hits")
    )
    scored = hits.mapInPandas(_resolve, "rid long, kind string, a string, b string, score double")
    ranked = scored.join(bounded_broadcast(entries), ["kind", "a", "b"], "left")
    best = ranked.groupBy("rid").agg(F.max_by(F.coalesce("item_id", F.lit(0)), F.struct(F.round("score", 9).alias("s"), F.col("item_id").isNotNull().alias("l"), (-F.coalesce("item_id", F.lit(0))).alias("i"))).alias("item_id"))
    return one.join(best, "rid", "left").select("kind", "first", "second", F.coalesce("item_id", F.lit(0).cast("long")).alias("item_id"))
