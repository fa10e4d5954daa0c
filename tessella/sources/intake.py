"""A profile's record store in a folder: batches of additions are checked, enriched, stored, indexed and put on record.

Parts of ``store`` (see commits), each a folder of batches:

* ``staged``: the batch as it came, one row of equal contents, with types and vectors;
* ``verdicts``: what became of each uuid; ``accepted``: the rows that go in, enriched;
* ``records``: versions of records, of which the newest counts; ``gone``: uuids whose earlier versions no longer count;
* ``history``: (uuid, action, changed, ts).

Beside it lie an inverted index (``words``) and a vector index (``vectors``) of the same batch numbers. The commit in ``store`` comes
last: a batch that broke off is taken up where it was, with the answers that models gave before, and one that is delivered twice changes
nothing, which suits foreachBatch. Batches come in order.
"""

from __future__ import annotations

import posixpath
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import enrich, filters, passes
from ..operators.embed import Provider, embedded
from .commits import Versions
from .ivf import VectorIndex
from .logs import history
from .postings import BUCKETS, Postings
from .records import RECORD

VERDICT = "uuid long, verdict string, match long, contradicts long"
HISTORY = "uuid long, action string, changed array<string>, ts timestamp_ntz"
COLUMNS = [c.split()[0] for c in RECORD.split(", ")]


class Intake:
    """A profile's store; vectors have ``size`` components, missing ones come from ``providers`` (none: they stay missing)."""

    def __init__(self, spark: SparkSession, path: str, profile: str, size: int, providers: Sequence[Provider] = (), model: enrich.Model | None = None, buckets: int = BUCKETS):
        self.spark, self.profile, self.size, self.providers, self.model = spark, profile, size, providers, model
        self.commits = Versions(spark, posixpath.join(path, "store"), "records", RECORD)
        self.words = Postings(spark, posixpath.join(path, "words"), buckets)
        self.vectors = VectorIndex(spark, posixpath.join(path, "vectors"), size)

    def rows(self) -> DataFrame:
        """The records that count."""
        return self.commits.living().select(*COLUMNS)

    def verdicts(self) -> DataFrame:
        """(uuid, verdict, match, contradicts, batch) of all batches: added, supersedes, duplicate, possible_duplicate, repeated, known, rejected; match is the nearest record, or the row repeated."""
        return self.commits.read("verdicts", VERDICT, [b for b, _ in self.commits.log()])

    def ledger(self) -> DataFrame:
        """(batch, n, and how many got each verdict): one line for each batch that had rows."""
        names = ("added", "supersedes", "duplicate", "possible_duplicate", "repeated", "known", "rejected")
        return self.verdicts().groupBy("batch").agg(F.count("*").alias("n"), *[F.count_if(F.col("verdict") == v).alias(v) for v in names])

    def history(self) -> DataFrame:
        return self.commits.read("history", HISTORY, [b for b, _ in self.commits.log()])

    def add(self, incoming: DataFrame, batch: int, now: Column, duplicate: float = 0.97, possible: float = 0.95, contradiction: float = 0.85, jaccard: float = 0.0) -> bool:
        """Takes a batch in; False if it is there already.

        Rows of other profiles and without a uuid are left out. Of rows with the same uuid the one with the smallest content counts.
        A uuid that the store has is known, a content that a smaller uuid of the batch has is repeated; neither goes in. What a row
        contradicts is superseded by it. Columns of a record that incoming lacks are null, others are ignored.
        """
        if not self.commits.isnew(batch):
            return False
        before, old = self.commits.batches(), self.rows()
        if not self.commits.whole("staged", batch):
            self.commits.write(self._staged(incoming, now), "staged", batch)
        staged = self.commits.batch_rows("staged", f"{RECORD}, first long", batch)
        if not self.commits.whole("verdicts", batch):
            self.commits.write(self._told(staged, old, duplicate, possible, contradiction, jaccard), "verdicts", batch)
        told = self.commits.batch_rows("verdicts", VERDICT, batch)
        if not self.commits.whole("accepted", batch):
            fit = staged.join(told.where("verdict in ('added', 'supersedes')").select("uuid"), "uuid", "left_semi")
            self.commits.write(enrich.enriched(fit, self.model).select(*COLUMNS), "accepted", batch)
        new = self.commits.batch_rows("accepted", RECORD, batch)
        # what a row contradicts is hidden behind the smallest uuid that does
        by = told.where("verdict = 'supersedes'").groupBy(F.col("contradicts").alias("uuid")).agg(F.min("uuid").alias("_by"))
        hidden = old.join(by, "uuid").withColumns({"superseded_by": F.coalesce("superseded_by", "_by"), "updated_at": now}).select(*COLUMNS)
        self.commits.write(new.unionByName(hidden), "records", batch)
        self.commits.replace(hidden, batch, before)
        self.commits.write(history(old.join(by, "uuid", "left_semi"), self.commits.batch_rows("records", RECORD, batch), now), "history", batch)
        # the words of hidden records still count in the collection's statistics; their vectors are taken out
        self.words.write(new, batch)
        self._indexed(new.unionByName(hidden.withColumn("embedding", F.lit(None).cast("array<float>"))), batch)
        self.commits.commit(batch)
        return True

    def _staged(self, incoming: DataFrame, now: Column) -> DataFrame:
        """The batch with its types, defaults and vectors; ``first`` is the smallest uuid of the same content."""
        have = [F.col(f"`{c}`").cast(t).alias(c) if c in incoming.columns else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ", 1) for x in RECORD.split(", "))]
        rows = incoming.select(*have).where(F.col("uuid").isNotNull() & F.coalesce(F.col("profile") == self.profile, F.lit(True)))
        one = W.partitionBy("uuid").orderBy("content", F.xxhash64(*COLUMNS))
        rows = rows.withColumn("_rn", F.row_number().over(one)).where("_rn = 1").drop("_rn")
        rows = rows.withColumns({
            "profile": F.lit(self.profile), "data_type": T.resolved_type(F.coalesce("data_type", F.lit("CUSTOM")), T.heuristic_class(F.lower("content"))), "data_id": F.lower("data_id"),
            "source": F.coalesce("source", F.lit("agent")), "status": F.lit("active"), "superseded_by": F.lit(None).cast("long"), "protected": F.coalesce("protected", F.lit(False)),
            "created_at": F.coalesce("created_at", now), "updated_at": now, "trust_score": F.coalesce("trust_score", F.lit(0.5)), "reference_count": F.coalesce("reference_count", F.lit(0)),
            "sensitivity": F.coalesce("sensitivity", F.lit(0)), "priority": F.coalesce("priority", F.lit(1)), "keywords": F.coalesce("keywords", F.array().cast("array<string>")),
        })
        if self.providers:
            lack = F.coalesce(F.size("embedding") != self.size, F.lit(True))
            # one pass: rows that have a vector ask for none
            given = rows.withColumns({"_own": F.when(~lack, F.col("embedding")), "_text": F.when(lack, F.coalesce("content", F.lit("")))})
            rows = embedded(given, "_text", self.providers, self.size).withColumn("embedding", F.coalesce("_own", F.col("embedding").cast("array<float>"))).select(*COLUMNS)
        # by a digest, so that copies of a long text are counted before they move
        digest = F.sha2(F.coalesce("content", F.lit("")), 256)
        firsts = rows.groupBy(digest.alias("_d")).agg(F.min("uuid").alias("first"))
        return rows.withColumn("_d", digest).join(firsts, "_d").select(*COLUMNS, "first")

    def _told(self, staged: DataFrame, old: DataFrame, duplicate: float, possible: float, contradiction: float, jaccard: float) -> DataFrame:
        known = old.select("uuid", F.lit(True).alias("_known"))
        marked = staged.join(known, "uuid", "left")
        fresh = marked.where("_known is null and uuid = first")
        judged = passes.verdicts(fresh.select(*COLUMNS), old, duplicate, possible, contradiction, jaccard)
        none = F.lit(None).cast("long")
        others = marked.where("_known or uuid <> first")
        others = others.select("uuid", F.when(F.col("_known"), "known").otherwise("repeated").alias("verdict"), F.when(F.col("_known"), none).otherwise(F.col("first")).alias("match"), none.alias("contradicts"))
        return judged.select("uuid", "verdict", "match", "contradicts").union(others)

    def _indexed(self, rows: DataFrame, batch: int) -> None:
        changed = rows.select("uuid", F.col("data_type").alias("collection"), "embedding")
        if self.vectors.commits.last() is not None:
            self.vectors.write(changed, batch)
        elif not changed.where(F.size("embedding") == self.size).isEmpty():
            self.vectors.build(changed, batch)

    def compact(self, batch: int) -> bool:
        """New bases of the store and both indexes; verdicts and history stay. False if the batch is there already."""
        if not self.commits.isnew(batch):
            return False
        self.commits.write(self.rows(), "records", batch)
        self.words.compact(batch)
        if self.vectors.commits.last() is not None:
            self.vectors.compact(batch)
        self.commits.commit(batch, batch)
        return True

    def find(self, words: Sequence[str], k: int = 5) -> DataFrame:
        """(uuid, score): the best live records by words, from the index."""
        live = filters.status(self.rows()).select("uuid")
        return self.words.scores(list(words)).select("uuid", "score").join(live, "uuid", "left_semi").orderBy(F.desc("score"), "uuid").limit(k)

    def near(self, vector: Sequence[float], k: int = 5) -> DataFrame:
        """(uuid, sim): the nearest live records, from the index."""
        if self.vectors.commits.last() is None:
            return self.spark.createDataFrame([], "uuid long, sim double")
        return self.vectors.nearest(list(vector), k)[0].select("uuid", "sim")
