"""Exact duplicates, and reprints by trigram similarity."""

from __future__ import annotations

import gc
import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echolens.functions import text
from echolens.operators import tiles
from echolens.operators.order import best_match
from echolens.session import small_batches

# Similarity above which a story is a reprint, and the days that may lie between.
TITLE, BODY, TITLE_ONLY, DAYS = 0.6, 0.5, 0.9, 5


def exact_duplicates(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``new`` with ``duplicate_of``: the id of a stored, not hidden row of the same hash.  Stored ids are aggregated first, so a frequent hash is one row."""
    known = stored.where(~F.coalesce("url_hidden", F.lit(False))).groupBy("hash").agg(F.min("id").alias("duplicate_of"))
    return new.join(known, "hash", "left")


def reprint_pairs(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``(new_id, old_id, title_sim, text_sim)`` for all pairs that count as reprints.

    The answer has a line for every pair, so it grows with the square of a
    group of similar stories.  Tasks write the pairs of their tiles as they
    find them; no pair is stored or shuffled.
    """
    return _compared(_sided(new, stored, "id"), "pairs", _Texts(new, stored))


def closest_reprints(new: DataFrame, stored: DataFrame) -> DataFrame:
    """``(new_id, old_id)``: what ``best_reprints`` finds among ``reprint_pairs``, without making all pairs.

    Rows of one title, text and moment are a class, and classes are compared.
    """
    rows = _cut(_sided(new, stored))
    found = _compared(rows, "closest", _Texts(new, stored))
    pairs = found.where("old_id is not null").join(rows.where("side & 1 > 0").select(F.col("id").alias("new_id"), "c1", "c2"), ["c1", "c2"]).where("new_id <> old_id")
    return best_match(pairs, "new_id", F.col("title_sim") + F.col("text_sim"), "old_id").select("new_id", "old_id")


def _shown(df: DataFrame) -> DataFrame:
    return df.where(~F.coalesce("url_hidden", F.lit(False)))


#: Microseconds that may lie between two stories.
SPAN = DAYS * 86_400_000_000


def _rows(df: DataFrame, *own: str) -> DataFrame:
    """Rows by the hashes of title and text, with their class ``(c1, c2)``; ``own`` names what rows of a class must share besides."""
    at = F.unix_micros(F.col("published_at").cast("timestamp"))
    r = df.select("id", *[c for c in own if c != "id"], F.xxhash64("title").alias("title"), F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), at.alias("at"))
    return r.withColumns({"c1": F.xxhash64("title", "t1", "at", *own), "c2": F.xxhash64(F.lit("second"), "title", "t2", "at", *own), "stretch": F.coalesce(F.floor(F.col("at") / SPAN), F.lit(UNDATED))})


def _sided(new: DataFrame, stored: DataFrame, *own: str) -> DataFrame:
    """The rows of both, with ``side``: 1 new, 2 stored, 3 both, which the rows of one table are in one scan."""
    if new is stored:
        hidden = F.coalesce("url_hidden", F.lit(False)).alias("_hidden")
        return _rows(new.select("*", hidden), *own, "_hidden").withColumn("side", F.when(F.col("_hidden"), 1).otherwise(3)).drop("_hidden")
    return _rows(new, *own).withColumn("side", F.lit(1)).unionByName(_rows(_shown(stored), *own).withColumn("side", F.lit(2)))


class _Texts:
    """Similar titles and the trigrams of texts that meet another row, each made once."""

    def __init__(self, new: DataFrame, stored: DataFrame) -> None:
        self.new, self.old = new, new if new is stored else _shown(stored)
        self._titles = self._grams = None

    @property
    def titles(self) -> DataFrame:
        if self._titles is None:
            self._titles = _cut(similar_titles(self.new.select("title"), None if self.new is self.old else self.old.select("title"), TITLE))
            _tidy(self._titles)
        return self._titles

    def grams(self, asked: DataFrame) -> DataFrame:
        """``(t1, t2, blank, g, rare)`` of the texts of ``asked``, see ``tiles.named_pieces``; later calls must ask for no others."""
        if self._grams is None:
            small_batches(asked.sparkSession)
            words = lambda df: df.select(F.concat(F.lit("  "), F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+", "  "), F.lit(" ")).alias("words"), *[c for c in df.columns if c != "text"])
            found = words(self.new.select("text").limit(NAMED)).mapInArrow(tiles.named_pieces([]), "g array<short>, rare array<long>").select("rare").collect()
            often = Counter(g for r in found for g in r[0])  # this says only which trigrams have short names
            names = sorted(g for g, _ in often.most_common(tiles.NAMES))
            asked = asked.select("t1", "t2").distinct()  # the texts of no other rows are moved, and those of both sides once
            named = lambda df: df.select(F.xxhash64("text").alias("t1"), F.xxhash64(F.lit("second"), "text").alias("t2"), "text")
            texts = named(self.new) if self.new is self.old else named(self.new).union(named(self.old))
            texts = texts.join(asked, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("text").alias("text"))
            texts = words(texts.select("t1", "t2", "text", F.coalesce("text", F.lit("")).rlike(rf"\A{text.BLANK}*\z").alias("blank")))
            self._grams = _cut(texts.mapInArrow(tiles.named_pieces(names), "t1 long, t2 long, blank boolean, g array<short>, rare array<long>"))
            _tidy(self._grams)
        return self._grams


#: Texts whose trigrams are counted for short names.
NAMED = 1_000


def _tidy(df: DataFrame) -> None:
    """Has files of shuffles and tables that nothing reads any more deleted now, not when memory runs short."""
    gc.collect()
    df.sparkSession._jvm.System.gc()


def _compared(rows: DataFrame, want: str, texts: _Texts) -> DataFrame:
    """What ``tiles.compared_rows`` finds among the classes of the new and stored ``rows``.

    Classes of a title are one tile, or if they are many, tiles of a stretch of
    days (the cell).  Two tiles meet once, where titles are similar and days
    near or unknown, and bring every class once for both directions.
    """
    titles = texts.titles
    key = ["title", "cell", "part"]
    of = ["c1", "c2", "title", "t1", "t2", "at", "stretch"]
    first = F.min(F.when(F.expr("side & 2 > 0"), F.col("id"))) if want == "closest" else F.min("id")
    rows = rows.join(titles.select(F.explode(F.array("title", "other")).alias("title")).distinct(), "title", "left_semi")
    one = _cut(rows.groupBy(*of).agg(F.expr("bit_or(side)").alias("side"), first.alias("i1"), F.count_if(F.expr("side & 1 > 0")).alias("new_rows"), F.count_if(F.expr("side & 2 > 0")).alias("old_rows"), F.count(F.lit(1)).alias("rows")))
    whole = one.groupBy("title").agg((F.count(F.lit(1)) <= tiles.SETS).alias("whole"))
    cells = one.groupBy("title", "stretch").agg(F.count(F.lit(1)).alias("many"), F.sum("rows").alias("rows"), F.expr("bit_or(side)").alias("side")).join(whole, "title")
    cells = cells.withColumn("cell", F.when(F.col("whole"), F.lit(WHOLE)).otherwise(F.col("stretch")))
    cells = _cut(cells.groupBy("title", "cell").agg(tiles.parts(F.sum("many"), tiles.SETS).alias("parts"), F.sum("rows").alias("rows"), F.expr("bit_or(side)").alias("side")))
    others = cells.select(*[F.col(c).alias(n) for c, n in (("title", "other"), ("cell", "other_cell"), ("parts", "other_parts"), ("side", "other_side"))])
    met = cells.join(titles, "title").join(others, "other")
    near = (F.least("cell", "other_cell") <= UNDATED) | (F.abs(F.col("cell") - F.col("other_cell")) <= 1)
    meet = F.expr("((side & 1 > 0) AND (other_side & 2 > 0)) OR ((side & 2 > 0) AND (other_side & 1 > 0))")
    once = (F.col("title") != F.col("other")) | (F.col("cell") < F.col("other_cell")) | ((F.col("cell") == F.col("other_cell")) & (F.col("rows") > 1))  # a row alone would meet itself only
    met = met.where(near & meet & once).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("other_part", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    here = (F.col("title") == F.col("other")) & (F.col("cell") == F.col("other_cell"))
    met = met.where(~here | (F.col("part") <= F.col("other_part"))).withColumn("same", here & (F.col("part") == F.col("other_part")))
    met = _cut(met.select(*key, "other", "other_cell", "other_part", "same", "title_sim", F.xxhash64(*key, "other", "other_cell", "other_part").alias("pair")))
    theirs = met.where("not same").select(F.col("other").alias("title"), F.col("other_cell").alias("cell"), F.col("other_part").alias("part"), "title_sim", "pair", F.lit(1).alias("place"))
    places = met.select(*key, "title_sim", "pair", F.when(F.col("same"), 2).otherwise(0).alias("place")).union(theirs)
    placed = one.join(whole, "title").withColumn("cell", F.when(F.col("whole"), F.lit(WHOLE)).otherwise(F.col("stretch")))
    placed = placed.join(cells.select("title", "cell", "parts"), ["title", "cell"]).withColumn("part", F.pmod(F.xxhash64("c1", "c2"), "parts").cast("int"))
    placed = placed.select(*of, "cell", "part", "side", "i1", "new_rows", "old_rows").join(places.select(*key).distinct(), key, "left_semi")
    if want == "closest":
        twice = rows.where("side & 2 > 0").join(placed.where("old_rows > 1").select("c1", "c2", "i1"), ["c1", "c2"]).where("id <> i1").groupBy("c1", "c2").agg(F.min("id").alias("i2"))
        placed = placed.join(twice, ["c1", "c2"], "left")
    else:
        placed = placed.withColumn("i2", F.col("i1"))
    placed = _cut(placed)
    grams = texts.grams(placed)
    entries = placed.join(places, key).select("pair", "place", "title_sim", "c1", "c2", "t1", "t2", "at", "side", "i1", "i2", "new_rows", "old_rows")
    total = placed.groupBy(*key).count().join(places, key).agg(F.coalesce(F.sum("count"), F.lit(0))).first()[0]
    blocks = tiles.dealt(entries.join(grams, ["t1", "t2"]).drop("t1", "t2"), ["pair"], total * 16)  # whole sets are larger than sketches
    kind = one.schema["i1"].dataType.simpleString()
    shape = {"pairs": f"new_id {kind}, old_id {kind}, title_sim double, text_sim double", "later": f"id {kind}"}.get(want, f"c1 long, c2 long, old_id {kind}, title_sim double, text_sim double")
    found = blocks.groupBy("block").applyInArrow(tiles.compared_rows(BODY, TITLE_ONLY, SPAN, want), shape)
    if want == "pairs":
        return found
    found = _cut(found.distinct() if want == "later" else found)
    del rows, one, whole, cells, others, met, theirs, places, placed, grams, entries, blocks
    _tidy(found)
    return found


#: Stands for the stretch of days of a row without a date.
UNDATED = -(1 << 40)
#: Stands for all days, of a title with few rows.
WHOLE = UNDATED - 1


def similar_titles(left: DataFrame, right: DataFrame | None, least: float) -> DataFrame:
    """``(title, other, title_sim)`` of distinct titles, by their hashes, with a trigram similarity above ``least``; every two titles once.

    One is of ``left`` and the other of ``right`` (None: of ``left`` too).
    Titles are compared as sketches, tile by tile, and pairs whose sketches
    differ in too many bits end in the task.  Trigrams are compared for the
    others only.  Two ways lead to the same pairs: either every two titles of
    sizes that allow it meet once, or those do that share a trigram among the
    first, rarest ones.  Few rare trigrams make the second longer.
    """
    if right is None:
        both = left.distinct().withColumn("side", F.lit(3))
    else:
        both = left.distinct().withColumn("side", F.lit(1)).union(right.distinct().withColumn("side", F.lit(2)))
        both = both.groupBy("title").agg(F.sum("side").alias("side"))  # a title of both sides travels once, as 3
    grams = F.transform(text.trigrams("title"), lambda g: F.xxhash64(g))  # numbers are compared faster than strings
    named = both.select(F.xxhash64("title").alias("id"), "side", grams.alias("g"))
    named = _cut(named.select("id", "side", "g", F.size("g").alias("n"), *tiles.sketch("g"))).where("n > 0")  # later: Spark would test every row's title before they are made distinct
    sizes = sorted((r["n"], r["side"], r["count"]) for r in named.groupBy("n", "side").count().collect())  # no more rows than a title has letters
    pairs = (_met_all if _all_is_shorter(named, sizes, least) else _met_by_rare)(named, sizes, least)
    pairs = pairs.select(F.least("new_id", "old_id").alias("title"), F.greatest("new_id", "old_id").alias("other")).distinct()
    of = lambda name: named.select(F.col("id").alias(name), F.col("g").alias(f"{name}_g"))
    sims = pairs.join(of("title"), "title").join(of("other"), "other").select("title", "other", text.trigram_similarity(F.col("title_g"), F.col("other_g")).alias("title_sim"))
    same = named.where("side = 3").select(F.col("id").alias("title"), F.col("id").alias("other"), F.lit(1.0).alias("title_sim"))
    return sims.where(F.col("title_sim") > least).union(same)


def _first(share: float) -> Column:
    """How many of a set's rarest trigrams reach one of those that it shares with a set that is similar by ``share``."""
    return (F.col("n") - F.ceil(F.col("n") * share) + 1).cast("int")


def _all_is_shorter(named: DataFrame, sizes: list[tuple[int, int, int]], least: float) -> bool:
    """Whether rarest trigrams bring two titles together more often than every two once, as a few hundred titles show."""
    total = sum(s[2] for s in sizes)
    some = [r[0] for r in named.where(F.pmod(F.xxhash64("id"), F.lit(max(1, total // JUDGED))) == 0).select(F.slice("g", 1, 1_000)).limit(2 * JUDGED).collect()]
    often = Counter(g for row in some for g in row)
    rarest = Counter(g for row in some for g in sorted(row, key=lambda g: (often[g], g))[: int(len(row) * (1 - least)) + 1])
    met = sum(c * (c - 1) for c in rarest.values())
    return total <= tiles.FEW or met > len(some) * (len(some) - 1) / 2


#: Titles that the way to compare is judged by.
JUDGED = 1_000


def _met_all(named: DataFrame, sizes: list[tuple[int, int, int]], least: float) -> DataFrame:
    """Pairs of titles by sketches alone: titles in order of their sizes are cut into tiles, and every two tiles meet."""
    many: Counter[int] = Counter()
    for n, _, count in sizes:
        many[n] += count
    total = sum(many.values())
    rows = max(1, -(-total // (1 if total <= tiles.FEW else max(tiles.CUTS, -(-total // tiles.EVERY)))))
    starts, upto, ends = [], 0, {}
    for n in sorted(many):
        starts.append((n, upto, many[n]))
        for t in range(upto // rows, (upto + many[n] - 1) // rows + 1):
            ends[t] = (ends.get(t, (n, n))[0], n)
        upto += many[n]
    met = [(t, low, high) for low in ends for high in ends if low <= high and ends[high][0] * least <= ends[low][1] for t in {low, high}]
    spark = named.sparkSession
    start = F.broadcast(spark.createDataFrame(starts or [(0, 0, 1)], "n int, start long, many long"))
    meets = F.broadcast(spark.createDataFrame(met or [(0, 0, 0)], "tile int, low int, high int"))
    words = [f"w{w}" for w in range(tiles.WORDS)]
    tile = F.expr(f"CAST((start + pmod(xxhash64('tile', id), many)) div {rows} AS INT)")
    rows = named.join(start, "n").select("id", "side", "n", *words, tile.alias("tile")).join(meets, "tile")
    blocks = rows.repartition(max(1, len({m[1:] for m in met})), "low", "high")  # a task is long, but moves little
    return blocks.groupBy("low", "high").applyInArrow(tiles.near_sketches(least), "new_id long, old_id long")


def _met_by_rare(named: DataFrame, sizes: list[tuple[int, int, int]], least: float) -> DataFrame:
    """Pairs of titles by sketches, of those that share a trigram among the first, rarest ones of both; of the smaller set still fewer are enough."""
    words = [f"w{w}" for w in range(tiles.WORDS)]
    often = named.select(F.explode("g").alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("often"))
    ranked = named.select("id", F.explode("g").alias("gram")).join(often, "gram").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("often", "gram"))).alias("e"))
    ranked = _cut(ranked.join(named.drop("g"), "id").withColumn("e", F.slice("e", F.lit(1), _first(least))["gram"]))
    entries = ranked.select("id", "side", "n", *words, F.posexplode("e").alias("place", "gram")).withColumn("inner", F.col("place") < _first(2 * least / (1 + least))).drop("place")
    cuts = entries.groupBy("gram").agg(F.count_if(F.expr("side & 1 > 0")).alias("new_rows"), F.count_if(F.expr("side & 2 > 0")).alias("old_rows")).where("new_rows > 0 and old_rows > 0")
    cuts = _cut(cuts.withColumns({"lows": tiles.parts(F.col("new_rows"), tiles.SKETCHES), "highs": tiles.parts(F.col("old_rows"), tiles.SKETCHES)}))
    places = """concat(
        IF(side & 1 > 0, transform(sequence(0, highs - 1), h -> struct(own_low AS low, h AS high, IF(side = 3 AND h = own_high, 3, 1) AS side)), array()),
        IF(side & 2 > 0, filter(transform(sequence(0, lows - 1), l -> struct(l AS low, own_high AS high, 2 AS side)), e -> NOT (side = 3 AND e.low = own_low)), array()))"""
    own = lambda name: F.pmod(F.xxhash64("id"), name).cast("int")
    dealt = entries.join(cuts, "gram").withColumns({"own_low": own("lows"), "own_high": own("highs")})
    dealt = dealt.select("gram", "id", "n", "inner", *words, F.explode(F.expr(places)).alias("p")).select("gram", "id", "n", "inner", *words, "p.low", "p.high", "p.side")
    total = cuts.agg(F.coalesce(F.sum(F.expr("new_rows * highs + old_rows * lows")), F.lit(0))).first()[0]
    blocks = tiles.dealt(dealt, ["gram", "low", "high"], int(total))
    return blocks.groupBy("block").applyInArrow(tiles.alike_sketches(least), "new_id long, old_id long")


def best_reprints(pairs: DataFrame) -> DataFrame:
    """The stored story that each new one repeats most closely, ties to the smaller id."""
    return best_match(pairs, "new_id", F.col("title_sim") + F.col("text_sim"), "old_id")


def reprint_clusters(rows: DataFrame, pairs: DataFrame, earlier: Column | None = None) -> DataFrame:
    """``(id, card_id)`` by order of arrival (``id``): a row joins the best earlier *card*, never another reprint.

    ``earlier`` says in which pairs the old row came first, if not by id; a row
    that is never the new one of a pair is a card.

    A row is a card when none of its earlier neighbours is one.  Rounds decide
    all rows at once whose earlier neighbours say enough: one that is a card,
    or none that is undecided.  What still waits after ``ROUNDS`` of them, long
    chains of stories that each repeat the one before, is decided by tasks that
    hold ``CHUNK`` rows each.  Then every other row looks for its best card.
    """
    edges = stored(pairs.where(F.col("old_id") < F.col("new_id") if earlier is None else earlier).select("new_id", "old_id", (F.col("title_sim") + F.col("text_sim")).alias("score")))
    cards = _cards(edges.select("new_id", "old_id").distinct())
    told = edges.join(cards.select(F.col("id").alias("old_id")), "old_id").join(cards.select(F.col("id").alias("new_id")), "new_id", "left_anti")
    best = best_match(told, "new_id", F.col("score"), "old_id").select(F.col("new_id").alias("id"), F.col("old_id").alias("card_id"))
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("card_id", "id").alias("card_id"))


def clusters_among(rows: DataFrame) -> DataFrame:
    """What ``reprint_clusters`` says of rows and all their pairs, without making the pairs.

    A round takes what has no earlier neighbour among the undecided rows as
    cards and leaves their neighbours out, so a group of similar stories ends
    as soon as its first one is a card.  Pairs are made only of what waits
    after ``ROUNDS``, long chains.  Copies are never cards: one joins the first
    of its class if that is a card, else what the rows of its class find earlier.
    """
    texts = _Texts(rows, rows)
    words = lambda c: F.coalesce(F.lower(c).rlike(r"[\p{L}\p{N}]"), F.lit(False))
    hidden = F.coalesce("url_hidden", F.lit(False)).alias("hidden")
    like_itself = words("title") & (words("text") | (text.trimmed(F.coalesce("text", F.lit(""))) == "")) & ~hidden
    alone = F.when(~like_itself, F.col("id")).alias("alone")
    every = _cut(_rows(rows.select("id", "title", "text", "published_at", hidden, alone), "alone", "hidden"))
    left = _cut(every.groupBy("c1", "c2", "title", "t1", "t2", "at", "stretch", "hidden").agg(F.min("id").alias("id")))
    by_id = {"c1": F.xxhash64("c1", "id"), "c2": F.xxhash64("c2", "id")}
    cards = None
    both = lambda new, old: new.withColumn("side", F.lit(1)).unionByName(old.where("not hidden").withColumn("side", F.lit(2)))
    itself = F.when(F.col("hidden"), 1).otherwise(3)
    for _ in range(ROUNDS):
        later = _compared(left.withColumn("side", itself), "later", texts)
        news = _cut(left.join(later, "id", "left_anti"))
        cards = news if cards is None else cards.union(news)
        left = left.join(later, "id", "left_semi")
        if later.limit(1).count():
            left = left.join(_compared(both(left, news), "later", texts), "id", "left_anti")
        left = _cut(left)
        if not left.limit(1).count():
            break
    else:
        links = stored(_compared(left.withColumn("side", itself), "pairs", texts).where("old_id < new_id").select("new_id", "old_id"))
        told = links.select(F.col("new_id").alias("id")).join(_cards(links), "id", "left_anti")
        cards = cards.unionByName(left.join(told, "id", "left_anti"))
    cards = _cut(cards)
    copies = every.join(cards.select("c1", "c2", F.col("id").alias("card_id")), ["c1", "c2"]).where("id <> card_id").select("id", "card_id")
    rest = _cut(every.join(cards.select("c1", "c2"), ["c1", "c2"], "left_anti").withColumns(by_id))
    found = _compared(both(rest.drop("alone"), cards.withColumns(by_id)), "earlier", texts)
    pairs = found.join(rest.select(F.col("id").alias("new_id"), "c1", "c2"), ["c1", "c2"])
    best = best_match(pairs, "new_id", F.col("title_sim") + F.col("text_sim"), "old_id").select(F.col("new_id").alias("id"), F.col("old_id").alias("card_id")).union(copies)
    return rows.select("id").join(best, "id", "left").select("id", F.coalesce("card_id", "id").alias("card_id"))


#: Rounds over all rows, and rows that a task decides in order.
ROUNDS, CHUNK = 6, 20_000


def _cards(links: DataFrame) -> DataFrame:
    """``(id)`` of the cards among the rows of ``links(new_id, old_id)``."""
    later = links.select(F.col("new_id").alias("id")).distinct()
    decided = stored(links.select(F.col("old_id").alias("id")).distinct().join(later, "id", "left_anti").withColumn("card", F.lit(True)))
    left, news = links, decided
    for _ in range(ROUNDS):
        seen = stored(left.join(news.select(F.col("id").alias("old_id"), "card"), "old_id", "left"))
        state = seen.groupBy(F.col("new_id").alias("id")).agg(F.coalesce(F.max("card"), F.lit(False)).alias("met"), F.count_if(F.col("card").isNull()).alias("waits"))
        news = stored(state.where("met or waits = 0").select("id", (~F.col("met")).alias("card")))
        decided = decided.union(news)
        left = stored(seen.where("card is null").select("new_id", "old_id").join(news.select(F.col("id").alias("new_id")), "new_id", "left_anti"))
        if not left.limit(1).count():
            return decided.where("card").select("id")
    return decided.union(_in_order(left, news)).where("card").select("id")


def _in_order(links: DataFrame, news: DataFrame) -> DataFrame:
    """``(id, card)`` of what ``links`` leave undecided; ``news`` are the rows decided last, to which they may lead.

    Rows are dealt to tasks by ``CHUNK`` of their order.  In each round every
    task goes through its rows in order and decides what it can, so a chain
    advances by a whole chunk, and all chunks work beside one another.
    """
    ids = links.select(F.col("new_id").alias("id")).distinct().repartitionByRange("id").sortWithinPartitions("id")
    placed = stored(ids.select("id", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("place")))
    starts, upto = [], 0
    for part, n in sorted(tuple(r) for r in placed.groupBy("part").count().collect()):  # one row a partition
        starts.append((part, upto))
        upto += n
    start = F.broadcast(links.sparkSession.createDataFrame(starts, "part int, start long"))
    chunks = placed.join(start, "part").select(F.col("id").alias("new_id"), F.expr(f"(start + place) div {CHUNK}").alias("chunk"))
    left = stored(links.join(chunks, "new_id").select("new_id", "old_id", "chunk"))
    kind = left.schema["new_id"].dataType.simpleString()

    def resolve(pdf: pd.DataFrame) -> pd.DataFrame:
        card, olds = {}, {}
        for new, old, known in zip(pdf["new_id"].tolist(), pdf["old_id"].tolist(), pdf["card"].tolist(), strict=True):
            olds.setdefault(new, []).append((old, known))
        for new in sorted(olds):
            states = [card.get(old) if known is None else known for old, known in olds[new]]
            if True in states:
                card[new] = False
            elif None not in states:
                card[new] = True
        return pd.DataFrame({"id": list(card), "card": list(card.values())})

    decided = None
    while left.limit(1).count():
        seen = stored(left.join(news.select(F.col("id").alias("old_id"), "card"), "old_id", "left"))
        news = stored(seen.select("chunk", "new_id", "old_id", "card").groupBy("chunk").applyInPandas(resolve, f"id {kind}, card boolean"))
        decided = news if decided is None else decided.union(news)
        left = stored(seen.where("card is null").select("new_id", "old_id", "chunk").join(news.select(F.col("id").alias("new_id")), "new_id", "left_anti"))
    return decided


def shared_folder(spark: SparkSession) -> str:
    """The folder for tables between jobs that driver and executors share; one of our own only on a single machine where none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            import tempfile

            named = "file://" + tempfile.mkdtemp(prefix="echolens-")
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


_cut = stored  # for functions in which that name is a table's


def with_reprint(mention: Column, url: Column, source_id: Column, found_at: Column, own_url: Column) -> Column:
    """The list of reprints with one more, unless its address is the story's own or already there."""
    entry = F.struct(url.alias("url"), source_id.alias("source_id"), found_at.alias("found_at"))
    there = F.exists(mention, lambda r: r["url"] == url)
    return F.when((url == own_url) | F.coalesce(there, F.lit(False)), mention).otherwise(F.concat(mention, F.array(entry)))

