"""An inverted index of texts.

A posting list is cut into blocks of documents, so that the list of a word that a third of all texts hold is many rows, and
rows of one block meet when lists are joined.  A row holds a stem, a block, the ids of the block's texts with that stem and
the places of the stem in each.  Rows lie in folders by a hash of the stem, sorted by stem, so a search opens the folders of
its own stems and skips other row groups; it never reads a text.  Ids and places are in order and delta-coded by Parquet.

``statistics`` holds, for each stem, in how many texts it occurs.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.indexes.segments import Segments, bucket_of

TEXTS_A_BLOCK = 4096
#: Blocks whose lists are put together in one task and lie in one file.
BLOCKS_A_FILE = 16


class TextIndex(Segments):
    tables = {
        "postings": "stem string, block int, ids array<string>, places array<array<int>>",
        "texts": "id string",
        "statistics": "stem string, n long",
        "replaced": "id string",
    }
    partitions = {"postings": ("bucket",), "statistics": ("bucket",)}

    def write(self, rows: DataFrame, column: str = "claim", replaces: DataFrame | None = None) -> int:
        """Index the texts of ``rows`` (id and the column) as one more segment; ``replaces``: ids that earlier segments lose, besides those of ``rows``."""
        segment = self._new()
        own = rows.select("id", T.lexemes(F.col(column)).alias("lex"))
        blocks = max(1, math.ceil(rows.count() / TEXTS_A_BLOCK))
        each = own.select("id", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"), F.posexplode("lex").alias("at", "stem"))
        each = each.withColumn("bucket", bucket_of(F.col("stem"))).withColumn("slice", F.floor(F.col("block") / BLOCKS_A_FILE).cast("int"))
        dealt = each.repartition("bucket", "slice")  # both groupings below keep this partitioning
        places = dealt.groupBy("bucket", "slice", "stem", "block", "id").agg(F.sort_array(F.collect_list("at")).alias("places"))
        lists = places.groupBy("bucket", "slice", "stem", "block").agg(F.sort_array(F.collect_list(F.struct("id", "places"))).alias("x"))
        ordered = lists.sortWithinPartitions("bucket", "stem", "block")
        self._put(segment, "postings", ordered.select("bucket", "stem", "block", F.col("x.id").alias("ids"), F.col("x.places").alias("places")))
        found = self.table("postings", [segment]).groupBy("bucket", "stem").agg(F.sum(F.size("ids")).cast("long").alias("n"))
        self._put(segment, "statistics", found.sortWithinPartitions("bucket", "stem"))
        ids = rows.select("id")
        self._put(segment, "texts", ids)
        if self.live():
            gone = ids if replaces is None else ids.unionByName(replaces.select(F.col(replaces.columns[0]).alias("id")))
            self._put(segment, "replaced", gone.distinct())
        else:
            self._put(segment, "replaced", ids.limit(0))
        self._done(segment)
        return segment

    def frequencies(self, words: Sequence[str]) -> DataFrame:
        """(stem, n): in how many texts each word's stem occurs, from the statistics alone (texts that were replaced still count until a merge)."""
        stems = [T.stem(F.lit(w.lower())) for w in words]
        return self._of("statistics", stems).groupBy("stem").agg(F.sum("n").alias("n"))

    def _of(self, table: str, stems: Sequence[Column]) -> DataFrame:
        """Rows of the stems; what is compared with are constants, so folders are pruned and row groups skipped."""
        rows = self.table(table)
        return rows.where(F.col("bucket").isin(*[bucket_of(s) for s in stems]) & F.col("stem").isin(*stems))

    def matches(self, query: str) -> DataFrame:
        """(id, p0, p1, ...) of the texts that match: the places of each of the query's terms (excluded ones come last)."""
        clauses = T.parse_query(query)
        words = list(dict.fromkeys(w for excluded in (False, True) for c in clauses if c.excluded == excluded for p in c.phrases for w in p))
        if not clauses:
            return self.table("texts").select("id").where("false")
        stems = {w: T.stem(F.lit(w)) for w in words}
        lists = self._of("postings", list(stems.values())).select("segment", "block", "stem", F.explode(F.arrays_zip("ids", "places")).alias("x"))
        lists = self.without_replaced(lists.select("segment", "block", "stem", F.col("x.ids").alias("id"), F.col("x.places").alias("places")))
        columns = [F.max(F.when(F.col("stem") == stems[w], F.col("places"))).alias(f"p{i}") for i, w in enumerate(words)]
        found = lists.groupBy("id").agg(*columns)
        if all(c.excluded for c in clauses):  # texts with none of the words have no postings at all
            whole = self.without_replaced(self.table("texts").select("id", "segment")).select("id")
            found = whole.join(found, "id", "left")
        place = {w: F.col(f"p{i}") for i, w in enumerate(words)}
        holds = F.lit(True)
        for c in clauses:
            one = F.lit(False)
            for phrase in c.phrases:
                one = one | T.has_phrase_at([place[w] for w in phrase])
            holds = holds & (~one if c.excluded else one)
        return found.where(holds)

    def search(self, query: str, limit: int | None, frequency: bool = False, among: DataFrame | None = None) -> DataFrame:
        """(id, score) of the best texts, as ``plans.search.text_top`` ranks them, or of all (no limit); ``among``: ids that may be found."""
        clauses = T.parse_query(query)
        terms = list(dict.fromkeys(w for c in clauses if not c.excluded for p in c.phrases for w in p))
        rank = (T.rank_frequency_at if frequency else T.rank_cover_at)({w: F.col(f"p{i}") for i, w in enumerate(terms)})
        found = self.matches(query)
        if among is not None:
            found = found.join(among.select("id"), "id", "left_semi")
        scored = found.select("id", F.round(rank, 9).alias("score"))
        return scored if limit is None else scored.orderBy(F.desc("score"), "id").limit(limit)

    def merge(self) -> None:
        """Put all segments into one, without what was replaced."""
        live = self.live()
        if len(live) <= 1:
            return
        segment = self._new()
        texts = self.without_replaced(self.table("texts", live)).select("id")
        blocks = max(1, math.ceil(texts.count() / TEXTS_A_BLOCK))
        rows = self.table("postings", live).select("segment", "bucket", "stem", F.explode(F.arrays_zip("ids", "places")).alias("x"))
        rows = self.without_replaced(rows.select("segment", "bucket", "stem", F.col("x.ids").alias("id"), F.col("x.places").alias("places")))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")).withColumn("slice", F.floor(F.col("block") / BLOCKS_A_FILE).cast("int"))
        lists = rows.repartition("bucket", "slice").groupBy("bucket", "slice", "stem", "block").agg(F.sort_array(F.collect_list(F.struct("id", "places"))).alias("x"))
        ordered = lists.sortWithinPartitions("bucket", "stem", "block")
        self._put(segment, "postings", ordered.select("bucket", "stem", "block", F.col("x.id").alias("ids"), F.col("x.places").alias("places")))
        self._put(segment, "statistics", self.table("postings", [segment]).groupBy("bucket", "stem").agg(F.sum(F.size("ids")).cast("long").alias("n")).sortWithinPartitions("bucket", "stem"))
        self._put(segment, "texts", texts)
        self._put(segment, "replaced", texts.limit(0))
        self._done(segment)
        self._drop(live)
