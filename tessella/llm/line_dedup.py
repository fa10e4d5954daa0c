"""Line dedup (operator 2, DataFrame functions only): a log-template tree over lines.

Each line walks a tree of fixed depth: its number of tokens, then its first
``LEADING`` tokens, where a token with a digit counts as the wildcard ``<*>``. In a leaf
with differing lines, the tokens that most of its lines share at a position make the
leaf's template, other positions become wildcards; lines close enough to it belong to it.
What is left of a leaf is dealt out to several templates: a line's tokens that are rare at
their positions, next to those that ``CLOSE`` of its tokens reach, become wildcards, and lines
that are equal then have a template. All other lines are templates of their own (with their digits generalised). A template
recurs if it is in at least ``min_docs`` documents. A line with fewer than
``LEAST_CONSTANT`` constant tokens (short ones, mostly numbers, scripts without blanks)
isn't generalised: its template is its verbatim text, which counts as any other with
``short``, as in the query and the pipeline, and never recurs without. Of a recurring template, the first line in order of (doc_id, text hash, line)
stays, all others are dropped: what a template's lines have in common is still said once, the words at its
wildcards are kept in that one line only.

Tokens are runs of characters other than blanks, tabs and carriage returns, so indentation and runs of
blanks are no tokens; verbatim text keeps them.

Only hashes and counts of lines are shuffled; token positions are looked at only for
lines in leaves that hold differing lines of different documents. Frequent lines are
summed up in each task before they are dealt out.

Defined cases: a null text stays null and has no lines; a line of blanks is never
dropped; repeated rows (same doc_id and text) count as one document and get the same
result; a null doc_id is a value like any other and comes first; an empty table stays
empty; other columns are kept by ``dedup_lines``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tables

LEADING = 3
MIN_DOCS = 2
LEAST_CONSTANT = 4
#: Share of a leaf's lines that must agree on a token, and of a line's tokens that must agree with the template.
AGREE, CLOSE = 0.5, 0.75
BROADCAST_ROWS = 1_000_000
#: A template in more documents than this, and than this share of what all recurring ones have, is hot.
HOT_DOCS, HOT_SHARE = 500, 1e-4
WILD = "<*>"


def masked(text: Column) -> Column:
    """A text whose tokens are separated by single blanks, none at the ends of lines, and those with a digit are wildcards; lines by line feeds."""
    flat = F.when(F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")), F.translate(text, "\t\r", "  ")).otherwise(text)
    wide = F.contains(flat, F.lit("  ")) | F.contains(flat, F.lit("\n ")) | F.contains(flat, F.lit(" \n")) | F.startswith(flat, F.lit(" ")) | F.endswith(flat, F.lit(" "))
    flat = F.when(wide, F.regexp_replace(flat, r"(?md)^ ++| ++$|(?<= ) ++", "")).otherwise(flat)
    # looks only at the starts of tokens and never goes back
    return F.when(text.rlike("[0-9]"), F.regexp_replace(flat, r"(?<![^ \n])[^ \n0-9]*+[0-9][^ \n]*+", WILD)).otherwise(flat)


def _count(text: Column, what: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))) / len(what)).cast("int")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, line_no, masked, n_tokens, leaf, own, enough) of each line that isn't blank; own is by the verbatim text if not enough.

    What concerns a text is worked out before its lines are laid out, so it is done once a text.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), F.arrays_zip(F.split(masked(F.col("text")), "\n", -1).alias("masked"), F.split("text", "\n", -1).alias("line")).alias("all"))
    # the outer form, as for the other one Spark splits each text once more to see whether it has lines
    rows = rows.select("doc_id", "th", F.posexplode_outer("all").alias("line_no", "x")).select("doc_id", "th", "line_no", "x.masked", "x.line").where(F.length("masked") > 0)
    n = _count(F.col("masked"), " ") + 1
    leaf = F.xxhash64(n, F.substring_index("masked", " ", LEADING))
    enough = n - _count(F.col("masked"), WILD) >= LEAST_CONSTANT
    own = F.when(enough, F.xxhash64("masked", F.lit("line"))).otherwise(F.xxhash64("line", F.lit("verbatim")))
    return rows.select("doc_id", "th", "line_no", "masked", n.alias("n_tokens"), leaf.alias("leaf"), own.alias("own"), enough.alias("enough"))


def leaf_lines(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(leaf, own, masked, n) of the different lines, with their numbers, in leaves that hold differing lines of several documents."""
    mixed = (
        index.where("enough").groupBy("leaf").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.min(F.struct("doc_id", "th")).alias("c"), F.max(F.struct("doc_id", "th")).alias("d"))
        .where("a <> b and not (c <=> d)").select("leaf")
    )
    mixed = tables.store(mixed, "leaves")
    if mixed.count() <= BROADCAST_ROWS:
        mixed = F.broadcast(mixed)
    lines = _lines(docs).select("leaf", "own", "masked", "enough").join(mixed, "leaf", "left_semi").where("enough")
    return tables.store(lines.groupBy("leaf", "own").agg(F.count("*").alias("n"), F.min("masked").alias("masked")), "leaf_lines")


def leaf_templates(lines: DataFrame) -> DataFrame:
    """(leaf, template) of the leaves whose lines generalise to one template."""
    tokens = lines.select("leaf", "n", F.split("masked", " ", -1).alias("all")).select("leaf", "n", F.posexplode_outer("all").alias("at", "token"))
    votes = tokens.groupBy("leaf", "at", "token").agg(F.sum("n").alias("n"))
    best = votes.groupBy("leaf", "at").agg(F.max(F.struct("n", "token")).alias("top"), F.sum("n").alias("n"))
    # as many rows for a leaf as a line has tokens
    token = F.when(F.col("top.n") > AGREE * F.col("n"), F.col("top.token")).otherwise(WILD)
    by_place = best.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("at", token.alias("token")))).alias("t"))
    template = by_place.select("leaf", F.transform("t", lambda x: x["token"]).alias("template"))
    constant = F.size(F.filter("template", lambda x: x != WILD))
    return template.where((constant >= LEAST_CONSTANT) & (constant >= CLOSE * F.size("template")))


def leaf_groups(lines: DataFrame) -> DataFrame:
    """(leaf, own, template) of the lines that are equal to others of their leaf in all but tokens that are rare at their positions."""
    tokens = lines.select("leaf", "own", "n", F.split("masked", " ", -1).alias("all")).select("leaf", "own", "n", F.posexplode_outer("all").alias("at", "token"))
    tokens = tokens.withColumn("key", F.xxhash64("leaf", "at", "token"))
    votes = tables.store(tokens.where(F.col("token") != WILD).groupBy("key").agg(F.sum("n").alias("v")).where("v > 1"), "votes")
    if votes.count() <= BROADCAST_ROWS:
        votes = F.broadcast(votes)
    place = F.struct("at", F.coalesce("v", F.lit(0)).alias("v"), "token")
    # as many rows for a line as it has tokens
    each = tokens.join(votes, "key", "left").groupBy("leaf", "own").agg(F.sort_array(F.collect_list(place)).alias("t"))
    # what so many of the line's tokens reach is at least the number of lines of a template that has them
    reached = F.element_at(F.sort_array(F.transform("t", lambda x: x["v"]), asc=False), F.ceil(CLOSE * F.size("t")).cast("int"))
    # through an array of one, so that it is worked out once a line
    once = F.array(F.struct("t", reached.alias("q")))
    kept = F.transform(once, lambda s: F.when(s["q"] > 1, F.transform(s["t"], lambda x: F.when(x["v"] > AGREE * s["q"], x["token"]).otherwise(WILD))))[0]
    groups = each.select("leaf", "own", kept.alias("template")).where(F.size(F.filter("template", lambda x: x != WILD)) >= LEAST_CONSTANT)
    groups = tables.store(groups.select("leaf", "own", F.xxhash64("leaf", "template").alias("template")), "groups")
    several = groups.groupBy("template").count().where("count > 1").select("template")
    return groups.join(several, "template", "left_semi").select("leaf", "own", "template")


def assigned(docs: DataFrame, index: DataFrame) -> DataFrame:
    """index with the id of each line's template: its leaf's, if it is close to that, else its group's in the leaf, else its own."""
    lines = leaf_lines(docs, index)
    template = tables.store(leaf_templates(lines), "templates")
    # a wildcard of the template agrees with anything
    split = F.split("masked", " ", -1)
    agree = F.size(F.filter(F.zip_with(split, F.col("template"), lambda a, b: (a == b) | (b == WILD)), lambda x: x))
    near = tables.store(lines.join(template, "leaf").where(agree >= CLOSE * F.size("template")).select("leaf", "own"), "near")
    if near.count() <= BROADCAST_ROWS:
        near = F.broadcast(near)
    groups = leaf_groups(lines.join(near, ["leaf", "own"], "left_anti"))
    both = tables.store(near.select("leaf", "own", F.col("leaf").alias("template")).union(groups), "generalised")
    if both.count() <= BROADCAST_ROWS:
        both = F.broadcast(both)
    return index.join(both, ["leaf", "own"], "left").select("doc_id", "th", "line_no", F.coalesce("template", "own").alias("template_id"))


def dropped_lines(docs: DataFrame, min_docs: int = MIN_DOCS, short: bool = False) -> DataFrame:
    """(doc_id, th, line_no) of the lines to drop."""
    place = F.struct("doc_id", "th", "line_no")
    with tables.scratch() as keep:
        index = tables.store(_lines(docs).select("doc_id", "th", "line_no", "leaf", "own", "enough"), "lines")
        index = index if short else index.where("enough")
        lines = keep(tables.store(assigned(docs, index), "assigned"))
        # one row for a document and template first, so that a frequent template is counted in parts
        each = lines.groupBy("template_id", "doc_id", "th").agg(F.min("line_no").alias("line_no"))
        again = each.groupBy("template_id").agg(F.count("*").alias("n_docs"), F.min(place).alias("first")).where(F.col("n_docs") >= min_docs)
        again = keep(tables.store(again, "again"))
    # a template with more than a share of all memberships needs no shuffle: there are at most 1 / HOT_SHARE of them
    total = again.agg(F.sum("n_docs")).first()[0] or 0
    hot = F.col("n_docs") > max(HOT_DOCS, total * HOT_SHARE)
    told = lines.join(F.broadcast(again.where(hot).select("template_id", F.col("first").alias("hot"))), "template_id", "left")
    frequent = told.where("hot is not null").where(~F.col("hot").eqNullSafe(place))
    others = told.where("hot is null").drop("hot").join(again.where(~hot), "template_id").where(~F.col("first").eqNullSafe(place))
    return frequent.select("doc_id", "th", "line_no").union(others.select("doc_id", "th", "line_no"))


def dedup_lines(docs: DataFrame, min_docs: int = MIN_DOCS, short: bool = False) -> DataFrame:
    """docs with the recurring lines gone from text, and n_lines, n_dropped added (not where docs have such columns)."""
    plain = tables.doc_columns(docs)
    out = dropped_lines(plain, min_docs, short).groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line_no")).alias("gone"))
    # whether each line up to the last dropped one stays: runs of kept lines, each before a dropped one
    run = lambda g, j: F.concat(F.array_repeat(F.lit(True), g - F.coalesce(F.get("gone", j - 1), F.lit(-1)) - 1), F.array(F.lit(False)))
    out = out.select("doc_id", "th", F.size("gone").alias("n_gone"), F.flatten(F.transform("gone", run)).alias("stays"))
    # columns go by place, whatever their names
    rows = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    name, text = F.col(f"c{docs.columns.index('doc_id')}").cast("long"), F.col(f"c{docs.columns.index('text')}").cast("string")
    rows = rows.join(out, name.eqNullSafe(F.col("doc_id")) & (F.xxhash64(text) == F.col("th")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: F.coalesce(F.get("stays", i), F.lit(True))), "\n")
    new = F.when(F.col("n_gone").isNull(), text).otherwise(kept)
    n = F.when(text.isNull(), 0).otherwise(_count(text, "\n") + 1)
    more = {"n_lines": n, "n_dropped": F.coalesce("n_gone", F.lit(0))}
    taken = {c.lower() for c in docs.columns}
    return rows.select(
        *[(new if c == "text" else F.col(f"c{i}")).alias(c) for i, c in enumerate(docs.columns)],
        *[v.alias(k) for k, v in more.items() if k not in taken],
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(tables.read(spark, sf_dir, "documents").select("doc_id", "text"), short=True)
